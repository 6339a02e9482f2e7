"""Sum-of-weights ledger: one row per source file, kept beside the rows.

Totals must count files whose selected table is empty, so they are never taken
from surviving rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def ledger(events: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows and sum of weights per file before any cut (data: sum of ones)."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(w).alias("sum_w"))


def observed(events: DataFrame, weight: Column, name: str = "before_cuts") -> tuple[DataFrame, Observation]:
    """Total of the weights as a side result of the pass that writes the rows."""
    obs = Observation(name)
    return events.observe(obs, F.sum(weight).alias("sum_w"), F.count(F.lit(1)).alias("n_rows")), obs


def screen(catalog: DataFrame, counts: DataFrame, totals: DataFrame, strict: bool = False) -> DataFrame:
    """Usable files with their state: ``ok``, ``no_events`` (empty or missing
    table) or ``no_ledger``. ``strict`` makes a missing ledger an error."""
    out = catalog.join(counts, "path", "left").join(totals, "path", "left")
    state = F.when(F.col("sum_w").isNull(), "no_ledger").when(F.coalesce("n_rows", F.lit(0)) == 0, "no_events").otherwise("ok")
    if strict:
        state = F.when(F.col("sum_w").isNull(), F.raise_error(F.concat(F.lit("no ledger for "), F.col("path")))).otherwise(state)
    return out.withColumn("state", state)


def total_weights(files: DataFrame, ledger_sums: DataFrame, run_sums: DataFrame, event_sums: DataFrame, key: str = "path") -> DataFrame:
    """Sum of weights per file: ledger, else run table, else events; an error
    when all are missing."""
    out = files
    for name, table in (("_l", ledger_sums), ("_r", run_sums), ("_e", event_sums)):
        out = out.join(table.select(key, F.col("sum_w").alias(name)), key, "left")
    value = F.coalesce("_l", "_r", "_e")
    origin = F.when(F.col("_l").isNotNull(), "ledger").when(F.col("_r").isNotNull(), "runs").otherwise("events")
    msg = F.concat(F.lit("no sum of weights for "), F.col(key))
    checked = F.when(value.isNull(), F.raise_error(msg).cast("double")).otherwise(value)
    return out.withColumns({"sum_w": checked, "origin": origin}).drop("_l", "_r", "_e")


def channel_totals(catalog: DataFrame, totals: DataFrame) -> DataFrame:
    """Files and sum of weights per channel, empty files included."""
    return (
        catalog.join(totals, "path", "left")
        .groupBy("channel")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("sum_w", F.lit(0.0))).alias("sum_w"))
    )


def carry_over(old: DataFrame, new_path: Column) -> DataFrame:
    """Ledger rows of a source under the path of the new output."""
    return old.withColumn("path", new_path)
