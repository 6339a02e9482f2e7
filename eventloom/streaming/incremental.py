"""Skim new files only.

A skim skips inputs whose output exists. With a file-source
stream Spark keeps that list itself: every run takes the files that came since
the last one, applies the step list and appends rows and ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.steps import StepList, apply_steps
from eventloom.sources.ledger import ledger


def skim_new_files(spark: SparkSession, source: str, schema, steps: StepList, target: str, checkpoint: str, weight: str | None = None, columns: Sequence[str] = ()) -> None:
    """Process all files not seen yet and stop. A batch that is repeated after a
    lost driver overwrites its own output."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("source_file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, no: int) -> None:
        chosen = apply_steps(batch, steps)
        keep = [c for c in columns if c in chosen.columns] or chosen.columns
        chosen.select(*keep).write.mode("overwrite").parquet(f"{target}/rows/batch={no}")
        ledger(batch, ["source_file"], weight).write.mode("overwrite").parquet(f"{target}/ledger/batch={no}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
