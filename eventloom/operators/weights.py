"""Normalisation, balancing and efficiencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.scale import attach_totals


def mc_scale(lumi: Column, xsec: Column, total: Column, weighted_by_xsec: bool = False) -> Column:
    """lumi * cross-section * 1000 / sum of weights; only lumi when the weights
    contain the cross-section; 1 when the sum is not positive."""
    if weighted_by_xsec:
        return lumi
    return F.when(total > 0, lumi * xsec * 1000.0 / total).otherwise(F.lit(1.0))


def event_weight(base: Column, lumi: Column, xsec: Column, total: Column, mode: str = "standard_mc") -> Column:
    """``standard_mc`` scales to a yield; ``user_formula`` divides by the same norm."""
    if mode == "standard_mc":
        return base * (xsec * lumi * 1000.0 / total)
    if mode == "user_formula":
        return base / (total * xsec * lumi * 1000.0)
    raise ValueError(f"unknown weight mode {mode}")


def balanced(df: DataFrame, weight: str, klass: str, group: str, out: str = "balanced") -> DataFrame:
    """|w| scaled so that every group of a class sums to 1 / (groups of the class)."""
    w = F.abs(F.col(weight))
    sums = df.groupBy(klass, group).agg(F.sum(w).alias("_sum"))
    # group table: one row per (class, group)
    n = F.count_if(F.col("_sum") > 0).over(Window.partitionBy(klass))
    sums = sums.withColumn("_n", n).withColumnsRenamed({klass: "_k", group: "_g"})
    factor = F.when(F.col("_sum") > 0, 1.0 / F.col("_n") / F.col("_sum")).otherwise(F.lit(0.0))
    joined = df.join(sums, df[klass].eqNullSafe(sums["_k"]) & df[group].eqNullSafe(sums["_g"]), "left")
    return joined.select(*[df[c] for c in df.columns], (w * factor).alias(out))


def class_normalised(df: DataFrame, weight: str, klass: str, out: str = "normalised") -> DataFrame:
    """|w| / sum of |w| of the class."""
    t = attach_totals(df, [klass], _t=F.sum(F.abs(F.col(weight))))
    w = F.abs(F.col(weight))
    return t.withColumn(out, F.when(F.col("_t") > 0, w / F.col("_t")).otherwise(w)).drop("_t")


def class_targets(df: DataFrame, weight: str, klass: str, targets: dict, out: str = "targeted") -> DataFrame:
    """Scale the classes to relative targets (1 when not listed) and keep the
    overall sum of weights."""
    if any(v < 0 for v in targets.values()):
        raise ValueError("class targets must not be negative")
    sums = df.groupBy(klass).agg(F.sum(weight).alias("_sum"))
    rel = None
    for k, v in targets.items():
        rel = F.when(F.col(klass) == F.lit(k), F.lit(float(v))) if rel is None else rel.when(F.col(klass) == F.lit(k), F.lit(float(v)))
    rel = F.lit(1.0) if rel is None else rel.otherwise(F.lit(1.0))
    table = sums.withColumn("_rel", rel)
    alone = Window.partitionBy(F.lit(0))  # one row per class
    total = F.sum("_sum").over(alone)
    wanted = F.sum(F.when(F.col("_sum") > 0, F.col("_rel"))).over(alone)
    factor = F.when((F.col("_sum") > 0) & (total > 0), total * F.col("_rel") / wanted / F.col("_sum")).otherwise(F.lit(1.0))
    table = table.select(F.col(klass).alias("_k"), factor.alias("_f"))
    joined = df.join(table, df[klass].eqNullSafe(table["_k"]), "left")
    return joined.select(*[df[c] for c in df.columns], (F.col(weight) * F.col("_f")).alias(out))


def channel_shares(
    df: DataFrame, weight: str, klass: str, channel: str, shares: dict[object, dict[object, float]], out: str = "shared"
) -> DataFrame:
    """Fix the share of some channels inside a class; the rest of the class is
    spread over its other channels in proportion. Class sums do not change."""
    for k, chans in shares.items():
        if sum(chans.values()) > 1.0 + 1e-9 or any(not 0 <= v <= 1 for v in chans.values()):
            raise ValueError(f"shares of class {k} must lie in [0, 1] and not exceed 1 together")
    sums = df.groupBy(klass, channel).agg(F.sum(weight).alias("_sum"))
    target = F.lit(None).cast("double")
    fixed = F.lit(None).cast("double")
    for k, chans in shares.items():
        mine = F.col(klass) == F.lit(k)
        fixed = F.when(mine, F.lit(float(sum(chans.values())))).otherwise(fixed)
        for c, v in chans.items():
            target = F.when(mine & (F.col(channel) == F.lit(c)), F.lit(float(v))).otherwise(target)
    w = Window.partitionBy(klass)  # one row per channel of the class
    t = sums.withColumns({"_share": target, "_fixed": fixed})
    t = t.withColumns(
        {"_total": F.sum("_sum").over(w), "_free": F.sum(F.when(F.col("_share").isNull(), F.col("_sum"))).over(w)}
    )
    spread = (1.0 - F.col("_fixed")) * F.col("_sum") / F.col("_free")
    share = F.coalesce(F.col("_share"), F.when(F.col("_free") > 0, spread).otherwise(F.lit(0.0)))
    factor = (
        F.when(F.col("_fixed").isNull() | (F.col("_total") <= 0), F.lit(1.0))
        .when(F.col("_sum") > 0, F.col("_total") * share / F.col("_sum"))
        .otherwise(F.lit(0.0))
    )
    t = t.select(F.col(klass).alias("_k"), F.col(channel).alias("_c"), factor.alias("_f"))
    joined = df.join(t, df[klass].eqNullSafe(t["_k"]) & df[channel].eqNullSafe(t["_c"]), "left")
    return joined.select(*[df[c] for c in df.columns], (F.col(weight) * F.col("_f")).alias(out))


def inverse_frequency(df: DataFrame, klass: str, classes: Sequence) -> DataFrame:
    """Class weight N / (n_c * k), 0 for an empty class."""
    counts = df.filter(F.col(klass).isin(*classes)).agg(*[F.count_if(F.col(klass) == F.lit(c)).alias(f"n{i}") for i, c in enumerate(classes)])
    total = sum((F.col(f"n{i}") for i in range(len(classes))), F.lit(0))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias(klass),
                F.col(f"n{i}").alias("n"),
                F.when(F.col(f"n{i}") > 0, total / (F.col(f"n{i}") * len(classes))).otherwise(F.lit(0.0)).alias("class_weight"),
            )
            for i, c in enumerate(classes)
        ]
    )
    return counts.select(F.inline(rows))


def reweighting_report(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Per channel: events, sums before and after, effective scale."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(before).alias("before_sum"), F.sum(after).alias("after_sum")
    )
    eff = F.when(F.abs("before_sum") > 0, F.col("after_sum") / F.col("before_sum")).otherwise(F.lit(0.0))
    return out.withColumn("effective_scale", eff)


def tag_efficiency(rows: DataFrame, keys: Sequence[str], weight: str, tagged: dict[str, Column]) -> DataFrame:
    """Weighted efficiency per cell and working point, clipped to [0, 1]; one
    aggregation with a conditional sum per working point."""
    aggs = [F.sum(F.when(c, F.col(weight))).alias(f"_n_{wp}") for wp, c in tagged.items()]
    cells = rows.groupBy(*keys).agg(F.sum(weight).alias("den"), *aggs)
    out = F.array(
        *[
            F.struct(F.lit(wp).alias("working_point"), F.coalesce(F.col(f"_n_{wp}"), F.lit(0.0)).alias("num"))
            for wp in tagged
        ]
    )
    eff = F.when(F.col("den") != 0, F.least(F.greatest(F.col("num") / F.col("den"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return cells.select(*keys, "den", F.inline(out)).withColumn("eff", eff)


def binomial_efficiency(hist: DataFrame) -> DataFrame:
    """Efficiency with the error of a weighted binomial, from the columns
    num, num2, den, den2 (sums of weights and squared weights)."""
    a, va, b, vb = (F.col(c) for c in ("num", "num2", "den", "den2"))
    e = a / b
    var = F.abs(((1.0 - 2.0 * e) * va + e * e * vb) / (b * b))
    return hist.withColumns({"eff": F.when(b != 0, e).otherwise(F.lit(0.0)), "error": F.when(b != 0, F.sqrt(var)).otherwise(F.lit(0.0))})


def prescaled_or(passed: Sequence[Column], prescales: Sequence[float]) -> Column:
    """Weight of the OR of prescaled paths: 1 - product of (1 - pass / prescale)."""
    miss = F.lit(1.0)
    for p, s in zip(passed, prescales):
        miss = miss * (1.0 - p.cast("double") / F.lit(float(s)))
    return 1.0 - miss
