"""Weighted histograms as long tables.

One row per (keys, bin): ``ix`` (and ``iy``), ``sumw``, ``sumw2``, ``n``.
Every fill is a single grouped aggregation, so partial sums are made before the
shuffle and the shuffled data is bounded by the number of bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators.ranks import kth_smallest

#: above this many weights the fill explodes a weight list instead of adding
#: two aggregates per weight (keeps generated code inside its field limit)
WIDE_LIMIT = 30


def _moments(w: Column, suffix: str = "") -> list[Column]:
    return [F.sum(w).alias(f"sumw{suffix}"), F.sum(w * w).alias(f"sumw2{suffix}")]


def _bin_columns(axes: Sequence[Axis], clamp: bool) -> list[Column]:
    names = ("ix", "iy")
    make = (lambda a: a.clamped_index(F.col(a.var))) if clamp else (lambda a: a.index(F.col(a.var)))
    return [make(a).alias(n) for a, n in zip(axes, names)]


def _named(axes: Sequence[Axis]) -> list[str]:
    return ["ix", "iy"][: len(axes)]


def fill(df: DataFrame, axes: Sequence[Axis], weight: Column, keys: Sequence[str] = (), clamp: bool = False) -> DataFrame:
    """One- or two-dimensional fill with one weight. Rows without a value for
    an axis are not filled. ``clamp`` puts flow values into the outer bins."""
    bins = _named(axes)
    rows = df.select(*keys, *_bin_columns(axes, clamp), weight.cast("double").alias("_w")).dropna(subset=bins)
    return rows.groupBy(*keys, *bins).agg(*_moments(F.col("_w")), F.count(F.lit(1)).alias("n"))


def fill_array(
    df: DataFrame, coll: Column, fields: Sequence[str], axes: Sequence[Axis], weight: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Every element of a collection fills with the weight of its row."""
    # the outer form keeps Spark from adding a size filter that would compute a
    # derived collection a second time; empty collections fall out with the bins
    rows = df.select(*keys, weight.alias("_row_w"), F.explode_outer(coll).alias("_o"))
    rows = rows.select(*keys, "_row_w", *[F.col(f"_o.{f}").alias(f) for f in fields])
    return fill(rows, axes, F.col("_row_w"), keys)


def fill_weights(df: DataFrame, axes: Sequence[Axis], weights: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """All weights of one selection in a single pass; adds the column ``weight``."""
    bins = _named(axes)
    labels = list(weights)
    base = df.select(
        *keys, *_bin_columns(axes, False), *[weights[k].cast("double").alias(f"_w{i}") for i, k in enumerate(labels)]
    ).dropna(subset=bins)
    if len(labels) > WIDE_LIMIT:
        pairs = F.array(*[F.struct(F.lit(k).alias("weight"), F.col(f"_w{i}").alias("w")) for i, k in enumerate(labels)])
        rows = base.select(*keys, *bins, F.inline(pairs))
        return rows.groupBy(*keys, "weight", *bins).agg(*_moments(F.col("w")), F.count(F.lit(1)).alias("n"))
    aggs = [m for i in range(len(labels)) for m in _moments(F.col(f"_w{i}"), f"_{i}")]
    wide = base.groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("n"), *aggs)
    long = F.array(
        *[
            F.struct(F.lit(k).alias("weight"), F.col(f"sumw_{i}").alias("sumw"), F.col(f"sumw2_{i}").alias("sumw2"))
            for i, k in enumerate(labels)
        ]
    )
    return wide.select(*keys, *bins, "n", F.inline(long)).select(*keys, "weight", *bins, "sumw", "sumw2", "n")


@dataclass(frozen=True)
class Shift:
    """One variation: its own value, its own pass flag, its own weight."""

    name: str
    value: Column
    passed: Column
    weight: Column


def fill_shifts(df: DataFrame, axis: Axis, shifts: Sequence[Shift], keys: Sequence[str] = ()) -> DataFrame:
    """All variations of one variable in one scan; adds the column ``variation``.
    A failing row counts with weight zero, as a weight times its flag."""
    entries = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("variation"),
                axis.index(s.value).alias("ix"),
                (s.weight * s.passed.cast("double")).alias("w"),
                s.passed.alias("ok"),
            )
            for s in shifts
        ]
    )
    rows = df.select(*keys, F.inline(entries)).dropna(subset=["ix"])
    return rows.groupBy(*keys, "variation", "ix").agg(*_moments(F.col("w")), F.count_if("ok").alias("n"))


def fill_variables(df: DataFrame, axes: Sequence[Axis], weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Many one-dimensional variables in one scan; adds the column ``var``."""
    entries = F.array(*[F.struct(F.lit(a.var).alias("var"), a.index(F.col(a.var)).alias("ix")) for a in axes])
    rows = df.select(*keys, weight.cast("double").alias("_w"), F.inline(entries)).dropna(subset=["ix"])
    return rows.groupBy(*keys, "var", "ix").agg(*_moments(F.col("_w")), F.count(F.lit(1)).alias("n"))


def with_edges(hist: DataFrame, x: Axis, y: Axis | None = None) -> DataFrame:
    """Add the bin edges ``x_lo, x_hi`` (and ``y_lo, y_hi``)."""
    out = {"x_lo": x.low(F.col("ix")), "x_hi": x.high(F.col("ix"))}
    if y is not None:
        out |= {"y_lo": y.low(F.col("iy")), "y_hi": y.high(F.col("iy"))}
    return hist.withColumns(out)


def fold_flow(hist: DataFrame, keys: Sequence[str], nx: int, ny: int | None = None, low: bool = True, high: bool = True) -> DataFrame:
    """Move flow bins into the first and last visible bin, errors in quadrature."""

    def folded(name: str, n: int) -> Column:
        c = F.col(name)
        c = F.greatest(c, F.lit(1)) if low else c
        return (F.least(c, F.lit(n)) if high else c).alias(name)

    bins = [folded("ix", nx)] + ([folded("iy", ny)] if ny else [])
    names = ["ix"] + (["iy"] if ny else [])
    return (
        hist.select(*keys, *bins, "sumw", "sumw2", "n")
        .groupBy(*keys, *names)
        .agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("n").alias("n"))
    )


def scale(hist: DataFrame, factor: Column) -> DataFrame:
    """Multiply contents by a factor and squared errors by its square."""
    return hist.withColumns({"sumw": F.col("sumw") * factor, "sumw2": F.col("sumw2") * factor * factor})


def value_ranges(df: DataFrame, value: str, modes: dict[str, tuple[bool, bool]]) -> dict[str, tuple[float, float]]:
    """Ranges for automatic binning, of all modes together: minimum and maximum, or,
    where a mode trims its low or high end, the k-th smallest or largest value with
    k = max(1, 1% of the rows). The values are not sorted; the source is read once, or
    twice where an end is trimmed (more often only beyond millions of rows)."""
    trimmed = [any(ends[i] for ends in modes.values()) for i in (0, 1)]

    def ranks(n: int) -> list[int]:
        k = max(1, n // 100)
        return [r for r, wanted in zip((k, n - k + 1), trimmed) if wanted]

    found, lo, hi, _ = kth_smallest(df, value, ranks)
    low, high = found[0] if trimmed[0] else lo, found[-1] if trimmed[1] else hi
    return {m: (low if ends[0] else lo, high if ends[1] else hi) for m, ends in modes.items()}


def value_range(df: DataFrame, value: str, trim_low: bool = False, trim_high: bool = False) -> tuple[float, float]:
    """One mode of ``value_ranges``."""
    return value_ranges(df, value, {"": (trim_low, trim_high)})[""]
