"""Removal of line passages that were seen before, in DataFrame functions only.

A window is three consecutive lines (blank lines are passed over and always kept).
Windows are named by 128 hash bits of their lines; the first occurrence of a
window, by id, then position, stays, and the lines that later occurrences cover,
merged, are removed. Only hashes and positions are shuffled to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import text_of

#: lines of a window
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(lines: Column) -> Column:
    """The lines that are not blank, with their number."""
    numbered = F.transform(lines, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return F.filter(numbered, lambda x: F.trim(x["s"]) != "")


def _windows(solid: Column, width: int) -> Column:
    def one(k: Column) -> Column:
        parts = [solid[k + j]["s"] for j in range(width)]
        return F.struct(k.alias("k"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("h2"))

    starts = F.when(F.size(solid) >= width, F.sequence(F.lit(0), F.size(solid) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, one)


def _covered(starts: Column, width: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(starts, lambda k: F.sequence(k, k + (width - 1)))))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of ``df`` with ``text_col`` rid of repeated passages, and the columns
    ``_x_lines`` (lines before) and ``_x_removed`` (lines removed), int.

    A null text stays null with one line and none removed; a text of fewer than
    ``width`` lines that are not blank stays as it is. Rows that repeat id and text
    count as one place, so they keep the same lines; rows without an id come first.
    Lines are compared exactly. An empty table gives an empty result.
    """
    key = [F.col(id_col).alias("_x_id"), F.xxhash64(text_of(text_col)).alias("_x_hash")]
    windows = (
        df.select(*key, _lines(text_of(text_col)).alias("_x_all"))
        .where(F.size("_x_all") >= width)
        .withColumn("_x_solid", _solid(F.col("_x_all")))
        .select("_x_id", "_x_hash", F.inline(_windows(F.col("_x_solid"), width)))
    )
    place = F.struct("_x_id", "k", "_x_hash")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = windows.join(first, ["h1", "h2"]).where(place > F.col("first"))
    gone = later.groupBy("_x_id", "_x_hash").agg(F.collect_set("k").alias("_x_starts"))
    gone = gone.select(F.col("_x_id").alias("_x_gone_id"), F.col("_x_hash").alias("_x_gone_hash"), "_x_starts")

    rows = df.withColumn("_x_hash", F.xxhash64(text_of(text_col)))
    on = rows[id_col].eqNullSafe(gone["_x_gone_id"]) & (rows["_x_hash"] == gone["_x_gone_hash"])
    joined = rows.join(gone.hint("shuffle_hash"), on, "left").withColumn("_x_all", _lines(text_of(text_col)))
    solid = _solid(F.col("_x_all"))
    out = F.transform(_covered(F.col("_x_starts"), width), lambda c: F.col("_x_nos")[c])
    kept = F.array_except(F.sequence(F.lit(0), F.size("_x_all") - 1), F.col("_x_out"))
    return (
        joined.withColumn("_x_nos", F.when(F.col("_x_starts").isNotNull(), F.transform(solid, lambda x: x["i"])))
        .withColumn("_x_out", out)
        .withColumn(
            text_col,
            F.when(F.col("_x_out").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.col("_x_all")[i]), "\n")),
        )
        .withColumn("_x_lines", F.size("_x_all"))
        .withColumn("_x_removed", F.coalesce(F.size("_x_out"), F.lit(0)))
        .select(*df.columns, "_x_lines", "_x_removed")
    )
