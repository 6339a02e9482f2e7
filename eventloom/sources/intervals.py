"""Interval tables from nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRESCALES = "map<string,array<struct<lumisec_start:bigint,lumisec_end:bigint,hltprescale:double,l1prescale:double>>>"
RANGES = "map<string,array<array<bigint>>>"


def prescale_rows(docs: DataFrame, column: str) -> DataFrame:
    """``{run: [{start, end, p1, p2}]}`` to rows (run, lo, hi, value = p1 * p2);
    rows with a bad run, a reversed range or a value that is not finite go."""
    runs = docs.select(*[c for c in docs.columns if c != column], F.explode(F.from_json(column, PRESCALES)).alias("_run", "_list"))
    rows = runs.select(*[c for c in docs.columns if c != column], "_run", F.inline("_list"))
    value = F.col("hltprescale") * F.col("l1prescale")
    ok = (
        F.col("_run").rlike("^[0-9]+$")
        & (F.col("lumisec_end") >= F.col("lumisec_start"))
        & value.isNotNull()
        & ~F.isnan(value)
        & (F.abs(value) != float("inf"))
    )
    return rows.filter(ok).select(
        *[c for c in docs.columns if c != column],
        F.col("_run").cast("bigint").alias("run"),
        F.col("lumisec_start").alias("lo"),
        F.col("lumisec_end").alias("hi"),
        value.alias("value"),
    )


def run_ranges(docs: DataFrame, column: str) -> DataFrame:
    """``{run: [[lo, hi], ...]}`` to rows (run, lo, hi); keys that are not
    numbers are skipped."""
    keep = [c for c in docs.columns if c != column]
    runs = docs.select(*keep, F.explode(F.from_json(column, RANGES)).alias("_run", "_list"))
    rows = runs.select(*keep, "_run", F.explode("_list").alias("_r")).filter(F.col("_run").rlike("^[0-9]+$"))
    return rows.select(*keep, F.col("_run").cast("bigint").alias("run"), F.get("_r", F.lit(0)).alias("lo"), F.get("_r", F.lit(1)).alias("hi"))
