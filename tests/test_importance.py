"""Bijections of ranks and the importance of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import importance as I


def by_hand(x, n, rounds):
    for k, a, b in rounds:
        other = (k - x) % n
        u = (max(x, other) % I.PRIME * a + b) % I.PRIME
        x = other if u * u % I.PRIME % 2 else x
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_bijection(spark, n):
    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, a, b in I.round_numbers(4, 1)])
    got = [r["y"] for r in spark.range(n).select("id", I.bijected(F.col("id"), F.lit(n), rounds).alias("y")).orderBy("id").collect()]
    assert sorted(got) == list(range(n)) and got == [by_hand(x, n, I.round_numbers(4, 1)) for x in range(n)]
    if n == 1000:
        moved = np.abs(np.array(got) - np.arange(n))
        assert (moved > 0).mean() > 0.9 and abs(np.corrcoef(got, range(n))[0, 1]) < 0.15
        assert got != [by_hand(x, n, I.round_numbers(5, 1)) for x in range(n)]


def test_informative_group_matters(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 2, 400)
    rows = [(k, [float(c * 4 - 2 + rng.normal() / 3), float(rng.normal()), 1.0], int(c), 1.0 + k % 3) for k, c in enumerate(label)]
    rows += [(900, [0.0, None, 1.0], 0, 1.0), (901, None, 1, 1.0), (902, [9.0, 0.0, 1.0], None, 1.0)]
    df = spark.createDataFrame(rows, "k int, x array<double>, truth int, w double")
    layers = [([[-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]], [0.0, 0.0])]
    got = {(r["scope"], r["group"]): (r["baseline"], r["importance"]) for r in I.group_importance(df, ["k"], "x", "truth", "w", layers, {"good": [0], "noise": [1, 2]}, 3, 1).collect()}
    assert got.keys() == {(s, g) for s in ("all", "class 0", "class 1") for g in ("good", "noise")}
    assert got["all", "good"][0] == 1.0 and 0.4 < got["all", "good"][1] < 0.6
    # inside a class all values of the good feature are alike, and noise never counts
    assert [got[s, g][1] for s, g in sorted(got) if (s, g) != ("all", "good")] == [0.0] * 5
    again = {(r["scope"], r["group"]): r["permuted"] for r in I.group_importance(df.repartition(5), ["k"], "x", "truth", "w", layers, {"good": [0], "noise": [1, 2]}, 3, 1).collect()}
    assert again["all", "good"] == pytest.approx(1.0 - got["all", "good"][1])
    assert I.group_importance(df.where("false"), ["k"], "x", "truth", "w", layers, {"good": [0]}, 2).collect() == []


def test_rows_are_ordered_once(spark, sf, monkeypatch):
    """One stored ranking serves all permutations."""
    from eventloom.plans.extracting import group_importance

    plans = []
    real = I.written
    monkeypatch.setattr(I, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    df = group_importance(spark, sf)
    assert len(plans) == 1 and plans[0].count("row_number()") == 1
    assert "row_number" not in df._jdf.queryExecution().optimizedPlan().toString()
