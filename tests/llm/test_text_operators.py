"""The text operators against brute force on small inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import decontam, idstore, language, linededup, neighbours, packing, quality, queries, simhash, suffixes, webpages
from eventloom.llm.common import table, tokenizer_path, written
from eventloom.llm.linking import components
from eventloom.llm.tokens import Encoder
from eventloom.session import shared_dir

DOCS = "doc_id long, text string, source string, n int, k string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, k, "clash") for k, (i, t) in enumerate(rows)], DOCS)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c d e f g h"), (None, "a b c d e f g h"), (5, " \t\n "), (6, "long words here " * 4000)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


# ---------------------------------------------------------------- suffix dedup


def brute_kept(raws, length):
    seen = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(r), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group_runs", [2048, 1])
def test_suffix_dedup(spark, monkeypatch, group_runs):
    monkeypatch.setattr(suffixes, "SLICE", 3000)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), 6)) for _ in range(300)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(6)]
    rows = list(base)
    for k in range(12):
        w = base[k % 6].split()
        for _ in range(3):
            w[int(rng.integers(len(w)))] = "zz"
        cut = int(rng.integers(40, 160))
        rows.append(" ".join([*w[:cut], *base[(k + 1) % 6].split()[cut:]]))
    rows += [base[0], base[0], "x" * 1500, "", None, "short", "ab" * 900 + base[2][:700]]
    found = suffixes.without_repeats(docs_of(spark, list(enumerate(rows))))
    if group_runs == 1:
        spans = suffixes.repeated_spans(docs_of(spark, list(enumerate(rows))), group_runs=1)
        got = {r["id"]: sum(hi - lo for lo, hi in suffixes.merged([tuple(s) for s in r["spans"]])) for r in spans.collect()}
        want = brute_kept([(t or "").encode() for t in rows], 400)
        assert {k: w[1] for k, w in enumerate(want) if w[1]} == got
        return
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
    want = brute_kept([(t or "").encode() for t in rows], 400)
    assert got == dict(enumerate(want))


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at, size = rng.integers(0, 300, 60), rng.integers(1, 90, 60)
    group = np.sort(rng.integers(0, 4, 60))
    order = suffixes.sorted_suffixes(suffixes.Polynomial(data), data, at, size, group)
    strings = [(g, bytes(data[a : a + s])) for g, a, s in zip(group, at, size)]
    assert [strings[i] for i in order] == sorted(strings)


def test_suffix_dedup_odd_rows(spark):
    out = suffixes.without_repeats(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == 0 and by[3]["n_removed"] == 0
    assert by[6]["n_removed"] == by[6]["n_bytes"] == 64000
    assert suffixes.without_repeats(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- neighbours


def test_neighbours_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect() if r["embedding"]]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in queries.op2_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        best = [ids[j] for j in np.lexsort((ids, -s)) if j != q][:20]
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, len(mine) + 1))
        assert [v[1] for _, v in sorted(mine.items())] == sorted((v[1] for v in mine.values()), reverse=True)
        hit += len(set(best) & {v for v, _ in mine.values()})
        total += len(best)
    assert hit / total >= 0.9


def recall_of_search(spark, x, **how):
    """Share of the true answers found by every 20th row, and the fewest answers."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, **how).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = range(0, len(x), 20)
    hits = [len(got.get(q, set()) & {j for j in np.argsort(-(x @ x[q]), kind="stable")[:21].tolist() if j != q}) for q in asked]
    return sum(hits) / (len(asked) * min(20, len(x) - 1)), min(len(got.get(q, ())) for q in asked)


@pytest.mark.parametrize("norms", ["outlier", "lognormal"])
def test_neighbours_uneven_norms(spark, norms):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((5000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if norms == "outlier":
        x[7] *= 10
    else:
        x *= np.exp(rng.standard_normal(5000))[:, None]
    recall, least = recall_of_search(spark, x, few=200)
    assert recall >= 0.9 and least == 20


@pytest.mark.parametrize("few", [0, 4096])
@pytest.mark.parametrize("n", [10, 50])
def test_neighbours_of_few(spark, n, few):
    x = np.random.default_rng(n).standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    recall, least = recall_of_search(spark, x, few=few)
    assert least == min(20, n - 1) and recall > 0.8


def test_neighbours_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (20, v), (3, v), (3, v), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (None, v), (120, [5.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 5.0), (0, 2, 20, 5.0), (20, 1, 0, 5.0), (20, 2, 3, 5.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_many_equal(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 2500, 0.5).otherwise(F.col("id") / 3000)).alias("embedding"))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") == 2480).collect():
        got[r["rank"]] = (r["vec_id"], r["score"])
    want = sorted(((-(1 + 0.5 * (0.5 if i < 2500 else i / 3000)), i) for i in range(3000) if i != 2480))[:20]
    assert [got[k + 1] for k in range(20)] == [(i, pytest.approx(-s)) for s, i in want]


# ---------------------------------------------------------------- tokens, packing, store

ODD_TEXTS = ["", " ", "a  b", " a\n\n b ", "it's  don't\t\tx", "x y z", "<|endoftext|> hi", "é ́x", "ΑΣ ΣΑΣ", "!! ?? ...", "12 345. 67", "日本 語", "a\x1cb \x85c", "İs ǅ", "a.b. c?! ok...", "²x 2². 5,", "a_b. _", "-a. (b), «c».", "x\n\ny \t z\n", "a&&& b%$ c' d's. e'!", "\n a", "a \n b\nc  \nd", "q_ w__. 3% %3 a3. a3"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_whole_texts(name, texts):
    e = Encoder(tokenizer_path(name))
    sample = [t or "" for t in list(texts.values())[:60]] + ODD_TEXTS
    plain = Tokenizer.from_file(tokenizer_path(name))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in sample]
    assert e.encode(sample) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library_on_random_strings(name):
    rnd = random.Random(11)
    bits = [*"abzAÉéİıßǅʼnſK’'\"“”«»…-–.,;:!?()[]<>|_&%$#@0159²½", *"  \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u200b\ufeff", "\u0301", "\u0307", "日", "ع", "Ω", "я", "😀", "n't", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "</w>", "BELEDİ", "ŞİRKETİ", "the", " The", "ing"]
    sample = ["".join(rnd.choices(bits, k=rnd.randint(1, 14))) for _ in range(30_000)]
    sample += ["BELEDİ, “x”", "ŞİRKETİ’Nİ.", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y"]
    plain = Tokenizer.from_file(tokenizer_path(name))
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(sample, add_special_tokens=False)]
    assert [t for t, a, b in zip(sample, Encoder(tokenizer_path(name)).encode(sample), want) if a != b] == []


def check_packing(rows, ids, window):
    seqs, cover = {}, {}
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part), len(ids[r["doc_id"]]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans, limit in [(s, window) for s in seqs.values()] + [(c, None) for c in cover.values()]:
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert limit is None or at <= limit
    assert cover.keys() == ids.keys()
    return sum(r["length"] for r in rows) / (window * len(seqs))


def test_packing(spark, sf, texts):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert check_packing(queries.op3_packing(spark, sf).collect(), ids, 2048) > 0.97


def test_best_fit_is_tightest():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    room, spots = [], packing.best_fit(lengths, 100)
    for n, (s, o) in zip(lengths, spots):
        fits = [r for r in room if r >= n]
        if s == len(room):
            assert not fits
            room.append(100)
        assert room[s] == (min(fits) if fits else 100) and o == 100 - room[s]
        room[s] -= n


def test_packing_odd_rows(spark):
    out = packing.packed(docs_of(spark, ODD), tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    assert sum(r["doc_tokens"] for r in out if r["start"] == 0) == sum(r["length"] for r in out) == sum(len(r["ids"]) // 4 for r in out)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert packing.packed(docs_of(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_id_store(spark, sf, texts):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(queries.op5_token_ids(spark, sf).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_id_store_odd_rows(spark):
    path = f"{shared_dir(spark)}/store-odd-{np.random.default_rng().integers(1 << 40)}"
    idstore.write_ids(docs_of(spark, ODD), path, tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(idstore.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert [len(x) for x in idstore.read_document(spark, path, 3)] == [2, 2] and idstore.read_document(spark, path, 99) == []
    idstore.write_ids(docs_of(spark, []), path + "-none", tokenizer_path("byte_bpe_50k.json"))
    assert idstore.read_ids(spark, path + "-none").count() == 0


# ---------------------------------------------------------------- line dedup


def test_line_dedup_odd_rows(spark):
    a, b, c, d = "first line", "second line", "third line", "fourth line"
    rows = [(2, "\n".join([d, a, b, c, "", "tail"])), (1, "\n".join([a, b, c])), (3, "\n".join([a, "", b, c, d, a, b, c])), (4, None), (5, ""), (1, "\n".join([a, b, c])), (6, f"{a}\n{b}")]
    got = sorted(((r["doc_id"], r["text"], r["_x_lines"], r["_x_removed"]) for r in linededup.without_repeats(docs_of(spark, rows)).collect()), key=str)
    want = [(1, f"{a}\n{b}\n{c}", 3, 0)] * 2 + [(2, f"{d}\n\ntail", 6, 3), (3, "", 8, 7), (4, None, 1, 0), (5, "", 1, 0), (6, f"{a}\n{b}", 2, 0)]
    assert got == sorted(want, key=str)
    assert linededup.without_repeats(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- decontamination


def test_decontamination_finds_edited_items(spark, sf):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    search = decontam.Items(items)
    rng = np.random.default_rng(4)
    tried, found = 0, 0
    for item, text in items:
        words = text.split()
        for _ in range(3):
            w = list(words)
            for _ in range(int(decontam.EDITS * len(words))):
                k = int(rng.integers(len(w)))
                w[k : k + 1] = [[], ["new"], [w[k], "more"]][int(rng.integers(3))]
            hits = search.search([" ".join(["before", "it", *w, "after", "it"])])[0]
            tried += 1
            found += item in {h[0] for h in hits}
    assert found / tried >= 0.97


def test_decontamination_finds_one_sided_edits():
    rng = np.random.default_rng(9)
    for n in (30, 59, 120):
        items = decontam.Items([(k, " ".join(f"w{k}x{j}" for j in range(n))) for k in range(12)])
        for kind in ("delete", "insert"):
            texts = []
            for k in range(12):
                w = [f"w{k}x{j}" for j in range(n)]
                for i in range(int(decontam.EDITS * n)):
                    at = int(rng.integers(1, len(w) - 1))
                    w[at : at + (kind == "delete")] = [] if kind == "delete" else [f"new{i}"]
                texts.append(" ".join(["before", "it", *w, "after", "it"]))
            assert [[h[0] for h in hits] for hits in items.search(texts)] == [[k] for k in range(12)]


def test_decontamination_against_sliding_windows(spark, sf, texts):
    items = decontam.Items([(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()][:12])
    memo = decontam._Memo()
    sample = [t or "" for t in texts.values() if t and len(t) < 1500][:80]
    for text, hits in zip(sample, items.search(sample)):
        h = decontam.word_hashes(text, memo)
        for item, mine, most, _, _ in items.items:
            best = min((decontam.edit_distance(mine, h[s : s + len(mine) + most].tolist(), most) for s in range(len(h))), default=most + 1)
            assert (best <= most) == (item in {x[0] for x in hits})


def test_decontamination_odd_rows(spark):
    items = decontam.Items([(1, None), (2, ""), (3, "one"), (4, "... !!"), (5, "a b c d e f g h"), (5, "a b c d e f g h")])
    out = decontam.with_hits(docs_of(spark, ODD), items).collect()
    assert len(out) == len(ODD)
    hits = {r["n"]: sorted({x["item_id"] for x in r["_x_hits"]}) for r in out}
    assert hits == {0: [], 1: [], 2: [3], 3: [3], 4: [5], 5: [5], 6: [], 7: []}
    assert decontam.with_hits(docs_of(spark, []), items).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_held_out(spark, sf):
    labels = {r["doc_id"]: r for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = [r for r in queries.op7_quality(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels]
    clean = [r["keep"] for r in got if labels[r["doc_id"]]["quality"] == 1 and labels[r["doc_id"]]["toxic"] == 0]
    junk = [r["keep"] for r in got if labels[r["doc_id"]]["quality"] == 0]
    toxic = [r["keep"] for r in got if labels[r["doc_id"]]["toxic"] == 1]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.05 and np.mean(toxic) < 0.4


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.8
    right = (0.95, 0.9, 0.8, 0.85)
    votes = ["".join(quality.GOOD if (t == (rng.random() < a)) else quality.BAD for a in right) for t in truth]
    model = quality.fit_label_model(Counter(votes))
    assert model.good == pytest.approx(0.8, abs=0.05)
    for t, a in zip(model.table, right):
        assert t[quality.GOOD][0] == pytest.approx(a, abs=0.05) and t[quality.BAD][1] == pytest.approx(a, abs=0.05)


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(spark, ODD)
    out = quality.with_score(docs, quality.fit(docs, none)).collect()
    assert len(out) == len(ODD) and all(0 <= r["_x_score"] <= 1 for r in out) and out[0]["k"] == "clash"
    assert quality.with_score(docs_of(spark, []), quality.fit(docs_of(spark, []), none)).count() == 0


# ---------------------------------------------------------------- main text


def brute_cut(costs, edges):
    def price(side):
        return sum(max(0, c) if not s else max(0, -c) for c, s in zip(costs, side)) + sum(w for i, j, w in edges if side[i] != side[j])

    return min(price([bool(m >> k & 1) for k in range(len(costs))]) for m in range(1 << len(costs))), price


def test_minimum_cut():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        costs = rng.normal(0, 1, n).tolist()
        edges = [(int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12)) if i != j]
        least, price = brute_cut(costs, edges)
        assert price(webpages.minimum_cut(costs, edges)) == pytest.approx(least)


def test_main_text():
    page = (
        "<html><head><title>no</title><script>if (a<b) '</p>'</script></head><body class='has-sidebar'><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>"
        "<div class='sidebar-left'><p>Related stories, all of them, are listed here.</p></div><article><h1>Title &amp; more</h1><p>First\n  paragraph with <b>bold</b> text.<br><p>Second&nbsp;one, unclosed."
        "<div class=\"ad\">Buy now!</div><form>Mail <input></form><ul><li>A point that matters here.</li></ul></article><section id=comments><article><p>I liked it a lot, thanks for it.</p></article></section>"
        "<div class='cookie-notice'>We use cookies.</div><footer>&copy; me</footer></body></html>"
    )
    assert webpages.main_text(page) == "Title & more\nFirst paragraph with bold text.\nSecond one, unclosed.\nA point that matters here."
    assert [webpages.main_text(x) for x in (None, "", "<p>", "<", "<!-- x", "<script>never closed", "<a title='x>y")] == [""] * 7


def test_main_text_odd_rows(spark, sf):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "", "y")], "page_id long, url string, html string, _x_more string")
    assert [r["_x_text"] for r in webpages.extracted(df).collect()] == ["", "", ""]
    assert webpages.extracted(df.limit(0)).count() == 0
    for r in queries.op8_main_text(spark, sf).limit(50).collect():
        assert r["n_chars"] == len(r["text"]) > 0


# ---------------------------------------------------------------- language model


def test_language_counts(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(language, "BANDS", (2048, 2200, 2400, 3000))
    words = {i: [*(t or "").encode().lower().split(), b" "] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = queries.op9_language_model(spark, sf).collect()
    assert len(rows) == len(words)
    for r in rows:
        ws = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and r["score"] < 0


def test_language_model_is_a_distribution(monkeypatch):
    monkeypatch.setattr(language, "BANDS", (2048, 2060, 2070, 2080))
    words = [b"w%d" % k for k in range(2080)]
    counts = np.arange(2080, 0, -1, dtype=float)
    vocabulary = language.Vocabulary(words, counts, int(counts.sum()) + 30, 2090)
    net = language.Network()
    first = [np.array([k], np.int32) for k in range(2080)]
    listed = 10 ** language.log10_scores(net, vocabulary, first)
    # ten unlisted words of three tokens each, and the unknown one
    opened = 10 ** language.log10_scores(net, vocabulary, [np.array([2080], np.int32)])[0]
    assert listed.sum() + opened * (10 * 3.5 + 0.5) == pytest.approx(1, abs=1e-4)


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = language.Network()
    token, fresh = rng.integers(0, 4000, (5, 3)).astype(np.int32), np.zeros((5, 3), bool)
    fresh[0], fresh[3, 1], token[4, 2] = True, True, -1
    h, before = np.zeros((3, language.STATE), np.float32), np.full(3, language.Network.BEGIN)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        docs = [token[:, 0], token[:3, 1], token[3:, 1], token[:4, 2]]
        out = 0.0
        for d in docs:
            s, b = np.zeros((1, language.STATE)), np.array([language.Network.BEGIN])
            for t in d:
                s = net.step(s, net.p["x"][b])[0]
                k = int(language._classes(np.array([t]))[0])
                at = lambda w: np.array([w])
                out -= net.class_log(s, at(k))[0] + (net.word_log(s, k, at(t - k * language.CLASS_WORDS))[0] if k < language.CLASSES else 0)
                b = language._inputs(np.array([t]))
        return out / 14

    grads, _, _ = language._window(net, token, fresh, h, before)
    for name in ("u", "v", "b", "c", "cb"):
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), grads[name].shape)
        old, eps = net.p[name][at], 1e-5
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=2e-3)


def test_language_held_out_beats_base(spark):
    rows = [r for r in queries.op9_language_model(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_learns_from_every_training_token(spark, sf, texts, monkeypatch):
    """Small slices, cut texts and several tasks: each token is learned from once."""
    monkeypatch.setattr(language, "TRAIN_SLICE", 3000)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.unionAll(docs.sparkSession.createDataFrame([(None, "a row without an id"), (10**6, "w " * 40_000)], docs.schema)).repartition(5)
    vocabulary = language.vocabulary_of(written(language.token_counts(docs)))
    net, learned = language.trained(docs, vocabulary)
    assert learned == vocabulary.total > 90_000
    start = language.Network(vocabulary=vocabulary)
    ranks = [vocabulary.ranks([*language.words_of(t or ""), language.END]) for i, t in texts.items() if not language.held_out(i)]
    assert language.log10_scores(net, vocabulary, ranks).sum() > language.log10_scores(start, vocabulary, ranks).sum()
    again = language.trained(docs, vocabulary)[0]
    assert all(np.allclose(net.p[k], again.p[k]) for k in net.p)


def test_language_starts_from_the_counts(monkeypatch):
    words = [b"w%d" % k for k in range(2500)]
    counts = np.arange(2500, 0, -1, dtype=float)
    vocabulary = language.Vocabulary(words, counts, int(counts.sum()), 2500)
    net = language.Network(vocabulary=vocabulary)
    net.p["c"][:], net.p["w"][:] = 0, 0
    alone = language.log10_scores(net, vocabulary, [np.array([k], np.int32) for k in (0, 70, 2047, 2300)])
    want = [vocabulary.log_count[k] - vocabulary.log_all for k in (0, 70, 2047, 2300)]
    assert alone == pytest.approx(want, abs=1e-3)
    same = net.unpacked(net.packed())
    assert all((same.p[k] == net.p[k]).all() for k in net.p)


def test_language_odd_rows(spark):
    out = language.scored(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 5)} == {1}
    assert language.scored(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_fingerprint(text, shingle=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, bits):
    root = list(range(len(points)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(points))]


def test_simhash(spark, sf, texts):
    ids = sorted(texts)
    points = [brute_fingerprint(texts[i]) for i in ids]
    groups = brute_components(points, 3)
    least = {}
    for i, g in zip(ids, groups):
        least[g] = min(least.get(g, i), i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", least[g]) for i, p, g in zip(ids, points, groups)}


def test_vantage_points_lose_no_link(spark):
    rng = np.random.default_rng(9)
    core = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = core[rng.integers(0, 400, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    points = np.unique(np.concatenate([core, near]))
    want = brute_components([int(p) for p in points], 3)

    def same(edges):
        root = {int(p): int(p) for p in points}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in edges:
            root[find(a)] = find(b)
        groups = [find(int(p)) for p in points]
        return len({(a, b) for a, b in zip(groups, want)}) == len(set(groups)) == len(set(want))

    assert same(simhash.links_within(points, 3, leaf=16))
    df = spark.createDataFrame([(int(p.view(np.int64)),) for p in points], "fp long")
    spread = simhash.linked(df, 3, tree_sample=256, shard_points=64, block_points=50).collect()
    assert same([(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in spread])


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6), *((k, k + 1) for k in range(100, 140))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {4: 3, 5: 3, 9: 3, 8: 7} | dict.fromkeys(range(101, 141), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(spark):
    rows = docs_of(spark, ODD)
    out = simhash.near_duplicates(rows).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert (by[1], by[2], by[5], by[3], by[4], by[None]) == (1, 1, 1, 3, 4, 4)
    kept = [r["doc_id"] for r in simhash.keep_one(rows).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 3, 4, 6, None], key=str)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0 and simhash.keep_one(docs_of(spark, [])).count() == 0


def test_suffix_query(spark, sf, texts):
    rows = queries.QUERIES["op1_suffix_dedup"](spark, sf).collect()
    want = brute_kept([(t or "").encode() for t in texts.values()], 400)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == dict(zip(texts, want))
    whole = {r["doc_id"]: r["text"] for r in rows if not r["n_removed"]}
    assert whole == {i: texts[i] or "" for i in whole} and len(whole) < len(rows)


@pytest.mark.parametrize(
    "page,chars",
    [("<script " * 700_000, 5_599_999), ('<script "' * 600_000, 5_400_000), ("<div>x" * 800_000, None), ("<div>" * 300_000 + "</p>" * 800_000, 0), ("<ul><li><ul>" + "<div>" * 300_000 + "<li>y</li>" * 300_000, None),
     ("<" * 5_000_000, None), ("<!-- " * 1_000_000, 0), ("<p '>" * 1_000_000, 0), ("a " * 2_500_000, 4_999_999)],
    ids=["unclosed", "quotes", "nested", "stray ends", "lists", "brackets", "comments", "quoted ends", "one block"],
)
def test_main_text_of_bad_pages(page, chars):
    """Five million characters of markup that never closes take time in proportion."""
    import time

    began = time.process_time()
    text = webpages.main_text(page)
    assert time.process_time() - began < 30 and (chars is None or len(text) == chars)


def test_scanner():
    tokens = lambda page: [(t or f"{'/' if closing else ''}{tag}{attributes}") for t, tag, closing, attributes in webpages._tokens(page)]
    assert tokens("a<p class=\"x>y\">b</p >c<br/>") == ["a", 'p class="x>y"', "b", "/p ", "c", "br/"]
    assert tokens("<!-- <p> --><SCRIPT a='>'>if (a<b) '</p>'</script >d<style>never") == ["d"]
    assert tokens("1 < 2 <3 <!doctype html><?x?></%><q") == ["1 ", "<", " 2 ", "<", "3 ", "<", "q"]
    assert tokens("<p a='x<b>y") == ["<", "p a='x", "b", "y"]
    blocks = webpages.blocks_of("<div><p>one<p>two</div><ul><li>three<li>four</ul>")
    assert [(b.text, b.tag, b.depth, b.shared) for b in blocks] == [("one", "p", 2, 0), ("two", "p", 2, 1), ("three", "li", 2, 0), ("four", "li", 2, 1)]
    weights = [w for _, _, w in webpages.edges_of(blocks)]
    near = webpages.ADJACENT + webpages.NEAR * webpages.FADE**2
    assert weights == pytest.approx([near, webpages.ADJACENT, near])


def test_cut_follows_the_neighbours():
    """A doubtful block takes the label of its neighbours in the tree, one of its own does not."""
    p = "<p>This is a sentence of a text that goes on for a while, as sentences of texts do.</p>"
    page = f"<div>{p}{p}<p>No.</p>{p}</div><div><div><a href=x>No.</a></div></div>"
    blocks = webpages.blocks_of(page)
    costs = [webpages.content_cost(b) for b in blocks]
    assert [c > 0 for c in costs] == [True, True, costs[2] > 0, True, False]
    costs[2] = -0.3
    keep = webpages.minimum_cut(costs, webpages.edges_of(blocks))
    assert keep == [True, True, True, True, False]
