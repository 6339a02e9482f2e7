"""Values at ranks by cells, against sorted values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import optimise as O
from eventloom.operators import ranks as R
from eventloom.operators.histogram import value_ranges


def frame(spark, x, w=None, parts=5):
    x = [None if v is None else float(v) for v in x]
    rows = list(zip(x, [1.0] * len(x) if w is None else [float(v) for v in w]))
    return spark.createDataFrame(rows, "x double, w double").repartition(parts)


def shapes(rng, n):
    return [rng.normal(size=n), rng.integers(0, 9, n).astype(float), np.exp(rng.normal(size=n) * 9), np.where(rng.random(n) < 0.6, 2.5, rng.normal(size=n)), np.append(rng.normal(size=n - 2), [np.inf, -np.inf])]


@pytest.mark.parametrize("cells", [64, 1 << 14])
def test_kth_smallest(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "CELLS", cells)
    rng = np.random.default_rng(cells)
    for x in shapes(rng, 3000):
        ranks = sorted(rng.integers(1, 3001, 9).tolist())
        rows = R.numbers(frame(spark, x), x=F.col("x"))
        found = R.settled_cells(rows, lambda c: [(c["x"], [np.ones(len(c["x"]))])], 1, lambda k, c: [float(r) for r in ranks], cells)
        assert found[0].reaching(np.array(ranks, float)).tolist() == [np.sort(x)[r - 1] for r in ranks]
    assert R.kth_smallest(frame(spark, [3, 1, None, 2, 2]), "x", lambda n: [1, n]) == ([1.0, 3.0], 1.0, 3.0, 4)
    with pytest.raises(ValueError, match="fewer"):
        R.kth_smallest(frame(spark, [1]), "x", lambda n: [2])
    with pytest.raises(ValueError, match="no data"):
        R.kth_smallest(frame(spark, [None]), "x", lambda n: [1])


def test_passes_over_the_source(spark, monkeypatch):
    """Two passes settle many ranks of values that are all different."""
    runs = []
    real = R._pass
    monkeypatch.setattr(R, "_pass", lambda *a: runs.append(1) or real(*a))
    x = np.random.default_rng(4).normal(size=200_000)
    df = spark.range(200_000, numPartitions=8).select(F.get(F.lit([float(v) for v in x[:1000]]), (F.col("id") % 1000).cast("int")).alias("a"), "id").select((F.col("a") + F.col("id") * 1e-9).alias("x")).cache()
    want = np.sort([r["x"] for r in df.collect()])
    got, lo, hi, n = R.kth_smallest(df, "x", lambda n: [n // 100, n // 2, n - 5])
    assert (got, lo, hi, n) == ([want[1999], want[99_999], want[199_994]], want[0], want[-1], 200_000)
    assert len(runs) == 2
    assert value_ranges(df, "x", {"a": (False, False)}) == {"a": (want[0], want[-1])} and len(runs) == 3
    df.unpersist()


def brute_scan(x, s, b, scans):
    x, s, b = np.array(x, float), np.array(s, float), np.array(b, float)
    down = -np.sort(-x)
    c = min(scans, len(x))
    cuts = sorted({down[k * (len(x) - 1) // max(1, c - 1)] for k in range(c)})
    return [(v, int((x >= v).sum()), round(s[x >= v].sum(), 5), round(b[x >= v].sum(), 5)) for v in cuts]


@pytest.mark.parametrize("scans", [1, 2, 7, 300])
def test_cut_scan(spark, monkeypatch, scans):
    monkeypatch.setattr(O, "CELLS", 128)
    rng = np.random.default_rng(scans)
    for x in shapes(rng, 1000):
        s, b = rng.random(1000), rng.random(1000)
        rows = [(float(v), float(p), float(q)) for v, p, q in zip(x, s, b)] + [(None, 1.0, 1.0)]
        df = spark.createDataFrame(rows, "x double, s double, b double").repartition(4)
        got = [(r["threshold"], r["rank"], round(r["signal_yield"], 5), round(r["background_yield"], 5)) for r in O.cut_scan(df, "x", "s", "b", scans).orderBy("threshold").collect()]
        assert got == brute_scan(x, s, b, scans)
    assert O.cut_scan(df.where("false"), "x", "s", "b", 5).collect() == []


def test_cut_scan_with_and_without_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 3, float(x), float(s), 1.0) for k, (x, s) in enumerate(zip(rng.integers(0, 90, 600), rng.random(600)))]
    df = spark.createDataFrame(rows, "g int, x double, s double, b double")
    key = lambda r: (r["threshold"], r["rank"], round(r["signal_yield"], 5))
    for g in range(3):
        alone = sorted(map(key, O.cut_scan(df.where(F.col("g") == g), "x", "s", "b", 20).collect()))
        assert alone == sorted(map(key, O.cut_scan(df, "x", "s", "b", 20, ["g"]).where(F.col("g") == g).collect()))


@pytest.mark.parametrize("bound", [True, False])
def test_rank_mixes(spark, monkeypatch, bound):
    monkeypatch.setattr(O, "MIX_CELLS", 1 << 10)
    rng = np.random.default_rng(5)
    n = 1500
    a, b, c, s, w = rng.random(n), rng.random(n), rng.integers(1, 5, n) / 4, rng.random(n), rng.random(n) * 9
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, s, w)], "a double, b double, c double, s double, w double").repartition(6)
    grid = O.simplex_grid(0.25, 3 if bound else 2)
    got = {r["point"]: (tuple(r["weights"]), r["threshold"], r["rank"], round(r["significance"], 9)) for r in O.rank_mixes(df, ["a", "b", "c"], "s", "w", grid, 40, bound=bound).collect()}
    for k, p in enumerate(grid):
        total = sum((q * v for q, v in zip(p, (a, b, c) if bound else (b, c))), np.zeros(n)) + 1e-6
        mix = (p[0] * a if bound else a) / total
        z = lambda s, b: np.sqrt(max(0.0, 2 * ((s + b) * np.log1p(s / b) - s))) if s > 0 and b > 0 else 0.0
        best = max(brute_scan(mix, s, w, 40), key=lambda r: (z(r[2], r[3]) if r[2] > 0 and r[3] > 0 else -1, r[0]))
        assert got[k][:3] == (p, best[0], best[1]) and abs(got[k][3] - z(best[2], best[3])) < 1e-7
    assert len(got) == len(grid)


def brute_edges(x, w, bins):
    v = np.unique(x)
    cum = np.cumsum([w[x == k].sum() for k in v])
    out = [v[0]]
    for k in range(1, bins):
        at = max(1, int(np.searchsorted(cum, cum[-1] * k / bins, "left")))
        out.append(0.5 * (v[at] + v[at - 1]))
    return [*out, v[-1]]


def test_equal_content_edges(spark, monkeypatch):
    monkeypatch.setattr(O, "CELLS", 32)
    rng = np.random.default_rng(6)
    for x, bins in itertools.product((rng.normal(size=2000), np.round(rng.normal(size=2000), 1)), (1, 2, 7)):
        w = rng.random(2000) * rng.integers(0, 2, 2000)
        assert O.equal_content_edges(frame(spark, x, w), "x", "w", bins) == pytest.approx(brute_edges(x, w, bins), abs=1e-12)
    with pytest.raises(ValueError, match="distinct"):
        O.equal_content_edges(frame(spark, [1, 1, 2]), "x", "w", 3)
    with pytest.raises(ValueError, match="distinct"):
        O.equal_content_edges(frame(spark, []), "x", "w", 3)
    with pytest.raises(ValueError, match="non-negative"):
        O.equal_content_edges(frame(spark, [1, 2, 3], [1, -1, 1]), "x", "w", 2, "signed")
