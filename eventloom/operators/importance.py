"""Permutation importance of feature groups, with repeats, over all rows and per class.

Rows are ranked once, in an order drawn from their key. A permutation is a bijection on
the ranks that is computed from the rank alone, so any number of groups and repeats
needs no further ordering: every row sends the values of a group to the row that gets
them, each row collects one piece per permutation, and all its altered vectors are
scored by one matrix product per batch. What leaves the tasks are sums per permutation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.scale import null_safe_join, shuffled_rank, written
from eventloom.operators.scoring import Layer

#: rounds of a bijection, and the prime of its round function
ROUNDS, PRIME = 12, 2147483647
#: altered vectors scored at a time
VECTORS = 1 << 15


def round_numbers(permutation: int, seed: int) -> list[tuple[int, int, int]]:
    """The drawn numbers of every round of a bijection."""
    rng = np.random.default_rng([seed, permutation])
    return [tuple(int(x) for x in rng.integers(1, PRIME, 3)) for _ in range(ROUNDS)]


def bijected(x: Column, n: Column, rounds: Column) -> Column:
    """A number in [0, n) for each x in [0, n), no two alike, for any n. Every round
    pairs x with ``k - x`` and swaps the two where a bit drawn for the pair says so.
    ``rounds`` is an array of structs ``k, a, b``."""

    def step(at: Column, p: Column) -> Column:
        other = F.pmod(p["k"] - at, n)
        u = ((F.greatest(at, other) % PRIME) * p["a"] + p["b"]) % PRIME
        return F.when((u * u) % PRIME % 2 == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def group_importance(
    df: DataFrame,
    key: Sequence[str],
    features: str,
    label: str,
    weight: str,
    layers: Sequence[Layer],
    groups: dict[str, Sequence[int]],
    repeats: int = 5,
    seed: int = 0,
) -> DataFrame:
    """``scope, group, baseline, permuted, importance``: weighted accuracy of a dense
    network before and after the features of a group are permuted together, the mean of
    the repeats, and the drop (0 at least). ``scope`` is ``all``, or ``class <label>``,
    where rows of one class only are permuted among themselves.

    ``features`` is an array of numbers, ``groups`` their positions. Rows without a
    label, or with a missing feature, do not take part; a missing weight counts 0.
    """
    names = list(groups)
    wanted = [(scope, g, r) for scope in (0, 1) for g in range(len(names)) for r in range(repeats)]
    rows = df.select(*key, F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("int").alias("_c"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"))
    rows = rows.where(F.col("_c").isNotNull() & F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    ranked = shuffled_rank(rows, "_rank", key, ["_c"], seed)
    # one row per class
    sizes = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_first": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(every)})
    placed = null_safe_join(ranked, sizes, ["_c"]).withColumn("_at", F.col("_rank") - 1)
    # the ranking is used on both sides of the exchange of values, so it is stored
    placed = written(placed.select("_x", "_c", "_w", "_n", "_first", "_all", "_at"))

    plans = F.array(
        *[
            F.struct(F.lit(no).alias("no"), F.lit(scope).alias("scope"), F.array(*[F.lit(i) for i in groups[names[g]]]).alias("cols"),
                F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, a, b in round_numbers(no, seed)]).alias("rounds"))
            for no, (scope, g, _) in enumerate(wanted)
        ]
    )
    sent = placed.select("_x", "_n", "_first", "_all", "_at", F.explode(plans).alias("p"))
    inside = F.col("_first") + bijected(F.col("_at"), F.col("_n"), F.col("p.rounds"))
    whole = bijected(F.col("_first") + F.col("_at"), F.col("_all"), F.col("p.rounds"))
    pieces = sent.select(F.when(F.col("p.scope") == 1, inside).otherwise(whole).alias("_to"), F.struct(F.col("p.no").alias("no"), F.transform("p.cols", lambda i: F.get("_x", i)).alias("v")).alias("piece"))
    # one piece per permutation
    got = pieces.groupBy("_to").agg(F.collect_list("piece").alias("pieces"))
    joined = placed.select((F.col("_first") + F.col("_at")).alias("_to"), "_x", "_c", "_w").join(got, "_to")

    matrices = [(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in layers]
    where = [np.array(groups[names[g]], np.int64) for _, g, _ in wanted]
    width, count = matrices[0][0].shape[1], len(wanted)

    def predicted(x: np.ndarray) -> np.ndarray:
        for no, (w, b) in enumerate(matrices):
            x = x @ w.T + b
            if no < len(matrices) - 1:
                x = np.maximum(x, 0.0)
        return x.argmax(axis=1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per class: weight of right rows without and with each permutation, weight
        sums: dict[int, np.ndarray] = {}
        at_once = max(1, VECTORS // (count + 1))
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                rows = part.num_rows
                x = part.column("_x").flatten().to_numpy().reshape(rows, width)
                altered = np.repeat(x[:, None, :], count + 1, axis=1)
                for i, pieces in enumerate(part.column("pieces").to_pylist()):
                    for piece in pieces:
                        altered[i, piece["no"] + 1, where[piece["no"]]] = piece["v"]
                truth, w = part.column("_c").to_numpy(), part.column("_w").to_numpy()
                right = predicted(altered.reshape(-1, width)).reshape(rows, count + 1) == truth[:, None]
                for c in np.unique(truth).tolist():
                    mine = truth == c
                    line = np.concatenate([(right[mine] * w[mine, None]).sum(0), [w[mine].sum()]])
                    sums[c] = sums.get(c, 0) + line
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["c", "sums"])

    parts = joined.select("_x", "_c", "_w", "pieces").mapInArrow(score, "c int, sums array<double>")
    long = parts.select("c", F.posexplode("sums").alias("i", "s")).groupBy("c", "i").agg(F.sum("s").alias("s"))
    both = long.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("class "), F.col("c").cast("string")))))
    # a permutation of the whole counts in the scope all, one inside classes in theirs
    kind = F.when(F.col("scope") == "all", 0).otherwise(1)
    plan = F.array(*[F.struct(F.lit(names[g]).alias("group"), F.lit(scope).alias("scope")) for scope, g, _ in wanted])
    base = both.groupBy("scope").agg(F.sum(F.when(F.col("i") == 0, F.col("s"))).alias("right"), F.sum(F.when(F.col("i") == count + 1, F.col("s"))).alias("w"))
    drawn = both.where(F.col("i").between(1, count)).withColumn("p", F.get(plan, F.col("i") - 1)).where(F.col("p.scope") == kind)
    mean = drawn.groupBy("scope", F.col("p.group").alias("group")).agg((F.sum("s") / repeats).alias("right_permuted"))
    accuracy = lambda right: F.when(F.col("w") > 0, F.col(right) / F.col("w")).otherwise(F.lit(0.0))
    out = mean.join(base, "scope").select("scope", "group", accuracy("right").alias("baseline"), accuracy("right_permuted").alias("permuted"))
    return out.withColumn("importance", F.greatest(F.lit(0.0), F.col("baseline") - F.col("permuted")))
