"""Skims that read every file once, survive bad files, and commit in two phases.

One pass over the events writes the kept rows and, beside them, what every task saw of
every file: rows, sum of weights before cuts, rows kept. Files that cannot be read give
no rows and are found by comparing with the listing. A run's output counts only once the
manifest names it: a run that broke off is never read, and an output whose rows are not
those its tasks counted is set aside, so that its input is due again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: states of an input: its output is complete; the file gave no rows (empty, not
#: readable, or gone); the rows written are not those counted
OK, NO_ROWS, INCOMPLETE = "ok", "no_rows", "incomplete"


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(_plain(F.col("path")).alias("path"), "length")


def tolerant_events(spark: SparkSession, folder: str, schema: StructType | None = None, pattern: str = "*") -> DataFrame:
    """Events of all files below a folder with their ``source`` path. Files that are not
    readable, or go while being read, give no rows instead of an error."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    events = (reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")).parquet(folder)
    return events.withColumn("source", _plain(F.col("_metadata.file_path")))


def split_rows(events: DataFrame, keep: Column, columns: Sequence[str | Column], weight: Column, source: str = "source") -> DataFrame:
    """Kept rows (``kind`` = events, in ``row``) and per task and file one row of counts
    (``kind`` = ledger: ``n_rows, sum_w, n_kept``), from one pass. Columns of rows that
    are not kept are not handed on; a missing weight counts 0."""
    flag = F.coalesce(keep, F.lit(False))
    rows = F.when(flag, F.struct(*columns))
    data = events.select(F.col(source).alias("source"), F.coalesce(weight.cast("double"), F.lit(0.0)).alias("w"), flag.alias("keep"), rows.alias("row"))
    kind = data.schema["row"].dataType
    schema = StructType().add("kind", "string").add("source", "string").add("row", kind).add("n_rows", "long").add("sum_w", "double").add("n_kept", "long")
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            keep = batch.column("keep")
            coded = batch.column("source").dictionary_encode()
            code, w = coded.indices.to_numpy(zero_copy_only=False), batch.column("w").to_numpy()
            flags = keep.to_numpy(zero_copy_only=False)
            sums = [np.bincount(code, x, len(coded.dictionary)) for x in (np.ones(len(code)), w, flags.astype(float))]
            for name, *part in zip(coded.dictionary.to_pylist(), *sums):
                seen[name] = seen.get(name, 0) + np.array(part)
            held = batch.filter(keep)
            n = held.num_rows
            if n:
                none = [pa.nulls(n, arrow.field(f).type) for f in ("n_rows", "sum_w", "n_kept")]
                yield pa.RecordBatch.from_arrays([pa.array(["events"] * n), held.column("source"), held.column("row").cast(arrow.field("row").type), *none], schema=arrow)
        if seen:
            n = len(seen)
            cols = [pa.array(["ledger"] * n), pa.array(list(seen)), pa.nulls(n, arrow.field("row").type)]
            cols += [pa.array([float(v[k]) if k == 1 else round(v[k]) for v in seen.values()], arrow.field(f).type) for k, f in enumerate(("n_rows", "sum_w", "n_kept"))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return data.mapInArrow(split, schema)


def run_skim(events: DataFrame, listing: DataFrame, store: str, keep: Column, columns: Sequence[str | Column], weight: Column) -> str:
    """Write one run into the store and commit it; returns its name. Every input of the
    listing gets a row in the manifest: ``run, path, state, n_rows, sum_w, n_kept``."""
    spark, run = events.sparkSession, uuid.uuid4().hex
    split_rows(events, keep, columns, weight).write.partitionBy("kind").parquet(f"{store}/runs/{run}")
    commit(spark, store, run, listing)
    return run


def commit(spark: SparkSession, store: str, run: str, listing: DataFrame) -> None:
    """Second phase: compare the rows of a written run with what its tasks counted, and
    name the run in the manifest."""
    parts = spark.read.parquet(f"{store}/runs/{run}")
    # one aggregation for both kinds
    counts = parts.groupBy("source").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("sum_w").alias("sum_w"), F.sum("n_kept").alias("n_kept"), F.count_if(F.col("kind") == "events").alias("n_written")
    )
    state = F.when(F.coalesce("n_rows", F.lit(0)) == 0, NO_ROWS).when(F.col("n_written") == F.col("n_kept"), OK).otherwise(INCOMPLETE)
    rows = listing.select("path").join(counts, F.col("path") == F.col("source"), "left")
    rows = rows.select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), "path", state.alias("state"), "n_rows", "sum_w", "n_kept")
    rows.write.mode("append").parquet(f"{store}/manifest")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """The last word on every input: a complete output if there is one, else the latest
    state. Empty while no run has been committed."""
    try:
        rows = spark.read.parquet(f"{store}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, run string, state string, n_rows long, sum_w double, n_kept long")
    pick = F.struct((F.col("state") == OK).alias("ok"), "at", "run", "state", "n_rows", "sum_w", "n_kept")
    return rows.groupBy("path").agg(F.max(pick).alias("m")).select("path", "m.run", "m.state", "m.n_rows", "m.sum_w", "m.n_kept")


def due(listing: DataFrame, store: str) -> DataFrame:
    """Inputs without a complete output."""
    done = manifest(listing.sparkSession, store).where(F.col("state") == OK).select("path")
    return listing.join(done, "path", "left_anti")


def kept_rows(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the complete outputs, each input once, with their ``source``."""
    good = manifest(spark, store).where(F.col("state") == OK).select(F.col("run").alias("_run"), F.col("path").alias("_path"))
    rows = spark.read.parquet(f"{store}/runs/*/kind=events")
    run = F.regexp_extract(F.col("_metadata.file_path"), "/runs/([0-9a-f]+)/", 1)
    rows = rows.select("source", "row", run.alias("run"))
    return rows.join(good, (F.col("run") == F.col("_run")) & (F.col("source") == F.col("_path")), "left_semi").select("source", "row.*")
