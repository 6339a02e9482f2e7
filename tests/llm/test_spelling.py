"""Spelling variants against edits tried one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import queries, spelling
from eventloom.llm.common import table

DOCS = "doc_id long, text string, word string, n int, form string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, k, "clash") for k, (i, t) in enumerate(rows)], DOCS)


def brute_counts(rows, least=5, times=3, every=97):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= times}


def brute_variants(counts):
    """Neighbours by all strings with one code point taken out."""
    holders, near = {}, {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            holders.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            if w[:k] + w[k + 1 :] in counts:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for same in holders.values():
        for w in same:
            near[w] |= same - {w}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[w] = [form, n, len(near[w]), counts.get(form)]
    rows = {}
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, k, m)
    return rows


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def given(spark, sf):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]


def test_query(spark, sf, given):
    want = brute_variants(brute_counts(given))
    rows = queries.QUERIES["op11_spelling"](spark, sf).collect()
    assert {r["word"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    assert sum(w[0] is not None for w in want.values()) > 20


def test_small_blocks(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abcdeé", k=rnd.randint(5, 7))) for _ in range(900)}
    words |= {"x" * 70, "x" * 71, "x" * 35 + "y" + "x" * 35, "a" * 5000, "a" * 5001, "aaaaa"}
    text = [(k, " ".join([w] * rnd.choice([3, 3, 4, 7, 30]))) for k, w in enumerate(sorted(words))]
    counts = brute_counts(text, every=10**12)
    want = brute_variants(counts)
    assert rows_of(spelling.variants(docs_of(spark, text), block=16)) == want
    assert {len(w[1]) for w in want.values()} & {70, 71, 5000}


def test_gram_pairs():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(300)} | {"b" * 64, "b" * 65, "b" * 66, "b" * 64 + "c"})
    places = np.arange(256) % spelling.DIMENSIONS
    half = len(words) // 2
    for left, right in ((words, None), (words[:half], words[half:])):
        a, b = (spelling._Block(w, [1] * len(w), places) if w else None for w in (left, right))
        i, j = spelling.near_pairs(a, b)
        got = {frozenset((left[x], (right or left)[y])) for x, y in zip(i, j)}
        want = {frozenset((x, y)) for x in left for y in (right or left) if spelling.one_edit(x, y)}
        assert got == want and len(i) == len(want)
    def edits(w):
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in "abc"} | {a + c + b for a, b in cuts for c in "abc"}
    for w in words[:40]:
        assert {v for v in words if spelling.one_edit(w, v)} == (edits(w) & set(words)) - {w}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Straße straße STRASSE"), (3, "Straße straße STRASSE"), (None, "straße strasse, strasse"), (4, "Łódź naïve naïve naïve’s naives"), (5, "naives " * 10 + "x" * 100_000), (6, "2naives3 \x00 \x1c")]
    assert rows_of(spelling.variants(docs_of(spark, rows))) == brute_variants(brute_counts(rows, every=10**12))
    rows = [(i, "spelling spelling " * 2) for i in range(400)]
    assert rows_of(spelling.variants(docs_of(spark, rows), drop_every=97)) == brute_variants(brute_counts(rows))
    assert spelling.variants(docs_of(spark, [])).collect() == []
    assert spelling.variants(docs_of(spark, [(1, "one two")])).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(docs_of(spark, []), times=1)
