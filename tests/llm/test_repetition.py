"""Periodic runs against all periods tried in turn."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from eventloom.llm import periods, queries
from eventloom.llm.common import table

DOCS = "doc_id long, text string, source string, start int, _x_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, k, "clash") for k, (i, t) in enumerate(rows)], DOCS)


def brute_runs(w, least_words=2, least_times=2):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x < len(w) - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            if x - s >= q:
                out.setdefault((s, x + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= max(least_words, least_times * q))


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def brute_row(doc_id, text):
    words = looped(doc_id, (text or "").encode().split())
    runs = brute_runs(words, 6, 4)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("step", [1, 3, 40])
def test_appended_words(step):
    rnd = random.Random(step)
    for _ in range(300):
        n, k = rnd.randint(0, 80), rnd.choice([1, 2, 3, 9])
        w = [rnd.randrange(k) for _ in range(n)]
        if n > 10 and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 2))
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
            w[rnd.randrange(n)] = rnd.randrange(k)
        catcher, at = periods.SquareCatcher(), 0
        while at < n:
            more = rnd.randint(1, step)
            catcher.append(np.array(w[at : at + more]))
            at += more
            if rnd.random() < 0.1:
                assert catcher.runs() == brute_runs(w[:at])
        assert catcher.runs() == brute_runs(w)


def test_many_overlapping_runs(monkeypatch):
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert periods.runs_of(list(b)) == brute_runs(b)
    monkeypatch.setattr(periods, "SLICE", 100)
    assert periods.runs_of(list(b)) == brute_runs(b)
    assert periods.runs_of(list(b), 6, 3) == brute_runs(b, 6, 3)


def test_long_texts():
    for words, period in ((["a"] * 300_000, 1), (["a", "b"] * 150_000, 2), ([str(k % 70_001) for k in range(300_000)], 70_001)):
        assert periods.runs_of(words, 6, 4) == [(0, 300_000, period)]
    assert periods.collapsed(list("xabababy"), [(1, 6, 2)]) == list("xaby")


def test_loops_of_a_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = {r["doc_id"]: b" ".join(looped(r["doc_id"], (r["text"] or "").encode().split())) for r in docs.collect()}
    got = {r["doc_id"]: b" ".join(r["text"].encode().split()) for r in periods.with_loops(docs).collect()}
    assert got == want and any(got[r["doc_id"]] != b" ".join(r["text"].encode().split()) for r in docs.collect())


def test_query(spark, sf):
    want = {r["doc_id"]: brute_row(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()}
    rows = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r[1:]) for r in rows} == want and len(rows) == len(want)
    assert sum(w[0] > 0 for w in want.values()) > 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y x y x y x y z"), (5, "a a \x1ca \x0ba"), (6, "la " * 50_000), (7, "a a a a a")]
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["_x_runs"]], r["_x_text"]) for r in periods.periodic_runs(docs_of(spark, rows)).collect())
    one = (4, [(0, 6, 1)], "a")
    assert got == [(0, [(0, 8, 2)], "x y z"), (1, [], ""), (2, [], ""), (3, [], ""), one, one, (5, [], "a a \x1ca a"), (6, [(0, 50_000, 1)], "la"), (7, [], "a a a a a")]
    assert periods.periodic_runs(docs_of(spark, [])).collect() == []
    empty = docs_of(spark, rows).where("false")
    assert periods.with_loops(empty).columns == ["doc_id", "text"] and periods.with_loops(empty).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(empty, least_times=1)
