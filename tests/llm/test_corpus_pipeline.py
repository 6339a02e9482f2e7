"""The pipeline: each stage against what its operator must do to the stage's input."""

from collections import Counter

import corpus_pipeline
import pytest
from compare import compare

from eventloom.llm import decontam, quality, queries
from eventloom.llm.common import table, written


def kept_of_near_copies(rows):
    """Ids that remain of ``rows`` (id, text): the smallest of each group of texts
    whose five-word shingles have a similarity of 0.8 or more, all pairs tried. Also
    the number of linked pairs of different sets."""
    sets, holders = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i in sets:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    links, linked = {i: set() for i in sets}, 0
    for i, mine in sets.items():
        shared = Counter(j for s in mine for j in holders[s] if j != i)
        links[i] = {j for j, n in shared.items() if 5 * n >= 4 * (len(mine) + len(sets[j]) - n)}
        linked += sum(mine != sets[j] for j in links[i])
    kept, seen = set(), set()
    for i in sorted(sets):
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += links[k]
    return kept, linked


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        outs.append(docs)
    fit, lines, single, clean, packed = outs
    assert all(o.columns == columns for o in outs[:4])
    model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = {r["doc_id"] for r in table(spark, sf, "documents").collect() if model.score(r["text"] or "") >= queries.KEEP_FROM}
    assert {r["doc_id"] for r in fit.collect()} == want
    assert {r["doc_id"] for r in lines.collect()} == want
    before = {r["doc_id"]: r["text"] for r in lines.collect()}
    kept, _ = kept_of_near_copies(before.items())
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {i: before[i] for i in kept}
    items = decontam.load_items(table(spark, sf, "benchmark"))
    hits = dict(zip([r["doc_id"] for r in single.collect()], items.search([r["text"] or "" for r in single.collect()])))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, h in hits.items() if not h}
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_line_dedup_sql(spark, con, sf):
    assert compare(spark, con, queries.QUERIES["op4_line_dedup"], queries.SQL["op4_line_dedup"], sf)[0] is None


def test_near_copies_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept, linked = kept_of_near_copies([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert linked
    assert {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()} == kept


GOOD = "The council met on Monday to discuss the new library. Members agreed that the building, which opened in 1962, needs repairs before the winter. A report on the cost is expected next month, and residents may comment on it until then."
KINDS = "doc_id long, text string, lang string, source string, n_chars long, _x_id string"
ROWS = [
    (1, GOOD, "en", "s", None, "x"), (2, None, "en", "s", 0, "x"), (3, "", "en", "s", 0, "x"), (None, GOOD + " More.", "en", "s", 1, "x"), (4, GOOD, "en", "s", 1, None),
    (4, GOOD + " Another sentence follows here for this one.", "en", None, 1, "x"), (5, (GOOD + " ") * 300, "en", "s", 1, "x"), (7, " \n\t", None, None, 1, "x"),
]


@pytest.mark.parametrize("docs,labels,items", [(ROWS, [(1, 1, 0), (None, 1, 0)], [(1, " ".join(GOOD.split()[5:25])), (None, None), (2, "")]), (ROWS, [], []), ([], [(1, 1, 0)], [(1, "an item")])], ids=["odd", "no labels or items", "no documents"])
def test_odd_rows(spark, tmp_path, docs, labels, items):
    for name, rows, kinds in (("documents", docs, KINDS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    now = table(spark, str(tmp_path), "documents")
    ids = []
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, now, str(tmp_path)))
        ids.append({r["doc_id"] for r in out.select("doc_id").collect()})
        assert len(ids) == 5 or out.columns == now.columns
        now = out
    assert ids[-1] == ids[-2] and corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    if not docs:
        assert ids == [set()] * 5
        return
    assert ids[0] == ids[1] and {1, 2, 3, 4, 7, None} <= ids[0]
    # texts without words are copies of each other; a row without an id stays
    assert ids[2] - {5} == {1, 2, None}
    assert ids[3] - {5} == ({2} if items else {1, 2, None})


def test_near_copies_by_fingerprint(spark):
    """Texts that differ in what is said once, beside a passage said 300 times: few
    fingerprint bits apart, their sets far apart."""
    from eventloom.llm.simhash import fingerprint

    tail = lambda name: " ".join(f"{name}{k}" for k in range(60))
    a, b = ((GOOD + " ") * 300 + tail(x) for x in "pq")
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() <= 3
    assert kept_of_near_copies([(1, a), (2, b)])[0] == {1, 2}
    docs = spark.createDataFrame([(2, b), (1, a), (3, tail("r")), (None, b)], "doc_id long, text string")
    out = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in out.collect()} == {1, 3, None}


def test_links_of_a_block_without_a_walk_over_pairs(monkeypatch):
    """Half of a crowded block is linked, the rest only looks alike: intersections are
    counted for the block at once."""
    import numpy as np

    from eventloom.llm import resemblance

    rng, common = np.random.default_rng(5), np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1000, 1 << 40, 10 if k % 2 else 60, dtype=np.uint64)])) for k in range(600)]
    sets += [sets[0], np.empty(0, np.uint64), np.empty(0, np.uint64)]
    both = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    assert both(sets[1], sets[3]) >= 0.8 * len(set(sets[1].tolist()) | set(sets[3].tolist())) > 0.8 * both(sets[0], sets[2])
    monkeypatch.setattr(np, "intersect1d", None)
    got = resemblance.links(list(range(len(sets))), sets, 0.8)
    assert sorted(got) == sorted([(600, 0), (602, 601)] + [(k, 1) for k in range(3, 600, 2)])
