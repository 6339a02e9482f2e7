"""Building blocks that keep plans whole and balanced on skewed, large tables.

* dimension data enters as inline relations, so Spark knows their size and
  decides about a broadcast itself;
* group totals are attached by a join, never by a window over a whole group:
  a single class may hold a third of all rows;
* ordered running sums and ranks work on small value ranges plus an offset per
  range, never on one global window.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions.vectors import double_array
from eventloom.session import shared_dir

def _sql_literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind in ("double", "float"):
        v = float(value)
        return f"CAST({v!r} AS {kind})" if math.isfinite(v) else f"CAST('{v}' AS {kind})"
    if kind == "string":
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if kind == "boolean":
        return "true" if value else "false"
    return f"CAST({value} AS {kind})"


def values_table(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """Inline relation from literal rows, ``schema`` like ``"era string, lumi double"``.

    It is a local relation with known statistics: joins against it become
    broadcast joins only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    fields = [part.split() for part in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(_sql_literal(v, k) for v, (_, k) in zip(row, fields)) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def written(df: DataFrame, **options: object) -> DataFrame:
    """Store an intermediate table in the shared folder and read it back, for
    results that several actions use. It survives the loss of executors. ``options``
    are those of the writer."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a missing key equals a missing key. The result has
    the columns of ``left``, then those of ``right`` that are not keys."""
    side = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = left.join(side, [left[k].eqNullSafe(side[f"_k_{k}"]) for k in keys], how) if keys else left.join(side, how="cross")
    return joined.drop(*[f"_k_{k}" for k in keys])


def attach_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row: partial aggregation, then a join whose
    form (broadcast or shuffle) follows the size of the group table at run time."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return null_safe_join(df, totals, keys, "left").select(*df.columns, *aggs)


def value_edges(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` increasing cut points with about equal row counts."""
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    row = df.agg(F.percentile_approx(F.col(value), shares, 10 * buckets).alias("e")).first()
    return sorted(set(row["e"] or []))


def kth_value(df: DataFrame, value: str, k: int, exact_rows: int = 100_000) -> float:
    """Exact k-th smallest value (k from 1).

    The values are cut into ranges, the range that holds the k-th is found from
    the range counts, and only its rows go on, until they are few or all equal.
    Every step is one aggregation; no task ever sorts the column.
    """
    rows = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    buckets = bucket_count(df)
    while True:
        edges = double_array(value_edges(rows, "_v", buckets))
        # a cut point is a value of the column and gets a range of its own, so a
        # very frequent value is split off and every round narrows the rest
        part = F.size(F.filter(edges, lambda e: e < F.col("_v"))) + F.size(F.filter(edges, lambda e: e <= F.col("_v")))
        ranges = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        for r in sorted(ranges.collect(), key=lambda r: r["p"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        else:
            raise ValueError(f"{value} has fewer values than asked for")
        if r["lo"] == r["hi"]:
            return r["lo"]
        rows = rows.filter(F.col("_v").between(r["lo"], r["hi"]))
        if r["n"] <= exact_rows:
            for v in rows.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).orderBy("_v").collect():
                if k <= v["n"]:
                    return v["_v"]
                k -= v["n"]


def bucket_count(df: DataFrame) -> int:
    """Value ranges per ordered pass: a few per shuffle partition, but no more
    than a row can be compared with cheaply."""
    return min(512, max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    groups: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Cumulative sums over one row per (groups, value), in order of ``value``.

    ``sums`` maps the new column to the summed one. Callers pre-aggregate to one
    row per value, so a heavily repeated value is one row here. Ranges of the
    value are summed in parallel; each adds the total of the ranges before it.
    """
    edges = value_edges(df, value, buckets or bucket_count(df))
    part = F.size(F.filter(double_array(edges), lambda e: e <= F.col(value))) if edges else F.lit(0)
    ranged = df.withColumn("_range", part)
    per_range = ranged.groupBy(*groups, "_range").agg(*[F.sum(src).alias(f"_s_{new}") for new, src in sums.items()])
    before = (
        Window.partitionBy(*groups, F.lit(0))
        .orderBy(F.desc("_range") if descending else F.asc("_range"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        *groups,
        "_range",
        *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums],
    )
    inside = (
        Window.partitionBy(*groups, "_range")
        .orderBy(F.desc(value) if descending else F.asc(value))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranged.select("*", *[F.sum(src).over(inside).alias(f"_l_{new}") for new, src in sums.items()])
    out = null_safe_join(local, offsets, [*groups, "_range"])
    return out.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])


def keyed_digest(*keys: Column, seed: int | str = 0) -> Column:
    """Hexadecimal digest of a row key; the same on every run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def keyed_uniform(*keys: Column, seed: int | str = 0) -> Column:
    """Number in [0, 1) drawn from a row key."""
    return F.conv(F.substring(keyed_digest(*keys, seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffled_rank(df: DataFrame, rank: str, keys: Sequence[str], groups: Sequence[str] = (), seed: int | str = 0) -> DataFrame:
    """1-based rank of every row inside its group in an order fixed by the seed.

    Rows are spread by the first digits of a digest of ``keys`` (which identify
    a row), so even a group with most of the rows is ranked by many tasks.
    """
    digest = keyed_digest(*[F.col(k) for k in keys], seed=seed)
    tagged = df.withColumn("_d", digest).withColumn("_range", F.substring("_d", 1, digest_digits(df)))
    return _ranked(df, tagged, rank, groups, [F.col("_d"), *[F.col(k) for k in keys]])


def digest_digits(df: DataFrame) -> int:
    """Leading digits that give several ranges per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 2 if parts <= 64 else 3 if parts <= 1024 else 4


def ordered_rank(df: DataFrame, rank: str, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """1-based rank of every row in the order of some columns, the first of them
    numeric and well spread (an event number). Ranges of that column are sorted
    in parallel; each adds the row count of the ranges before it."""
    edges = value_edges(df, order[0], buckets or bucket_count(df))
    part = F.size(F.filter(double_array(edges), lambda e: e <= F.col(order[0]))) if edges else F.lit(0)
    return _ranked(df, df.withColumn("_range", part), rank, [], [F.col(c) for c in order])


def _ranked(df: DataFrame, tagged: DataFrame, rank: str, groups: Sequence[str], order: list[Column]) -> DataFrame:
    counts = tagged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*groups, "_range").orderBy(*order)
    local = tagged.withColumn("_r", F.row_number().over(inside))
    joined = null_safe_join(local, offsets, [*groups, "_range"])
    return joined.select(*df.columns, (F.col("_o") + F.col("_r")).alias(rank))
