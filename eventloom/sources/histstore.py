"""Storing and loading histogram sets and selected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.histalgebra import check_same_binning, insert
from eventloom.operators.histogram import fold_flow, scale

KEYS = ("era", "channel", "var", "weight")


def save(hists: DataFrame, path: str) -> None:
    """Write a set, replacing the partitions it contains and no others."""
    (
        hists.repartition("era", "channel", "var")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("era", "channel", "var")
        .parquet(path)
    )


def load(spark: SparkSession, path: str, factor: float = 1.0, fold: int | None = None) -> DataFrame:
    """Read a set, scaled and (``fold`` = number of bins) with folded flow bins.
    Histograms of one variable must share one binning."""
    hists = spark.read.parquet(path)
    if "x_lo" in hists.columns:
        bad = check_same_binning(hists, ["var"])
        if not bad.isEmpty():
            raise ValueError(f"different binnings for {[r['var'] for r in bad.limit(20).collect()]}")
    hists = scale(hists, F.lit(factor)) if factor != 1.0 else hists
    return hists if fold is None else fold_flow(hists, KEYS, fold)


def variants(hists: DataFrame, channel: str | None = None) -> DataFrame:
    """(var, weight) variants that exist, of one channel or of all."""
    some = hists if channel is None else hists.filter(F.col("channel") == channel)
    return some.select("var", "weight").distinct()


def add_loaded(store: DataFrame, new: DataFrame) -> DataFrame:
    return insert(store, new, list(KEYS))


def snapshot(df: DataFrame, path: str, wanted: Sequence[str], partition_by: Sequence[str] = (), max_rows: int | None = None) -> None:
    """Write the requested columns that exist."""
    cols = [c for c in wanted if c in df.columns]
    writer = df.select(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    if max_rows is not None:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Summary rows as CSV or JSON."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path)
