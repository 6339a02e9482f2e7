"""Small helpers of the text operators.

Conventions of all operators in this package: the id and text columns are
parameters, other columns of the input are carried or ignored by name and never
clash with internal ones (internal names start with ``_x_``); a null text counts
as empty. Intermediate tables that several jobs read are stored in the folder of
``spark.checkpoint.dir``, so a lost executor costs a recomputed task only.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.scale import written

__all__ = ["arrow_map", "kept_in_worker", "pairs_of", "settings", "spread", "table", "text_of", "tokenizer_path", "written"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Default place of the public vocabulary files; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def kept_in_worker(key: tuple, make: Callable[[], object]):
    """What is costly to make, once per worker process: these outlive single tasks."""
    kept = sys.modules.setdefault("_eventloom_worker", types.ModuleType("_eventloom_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``mapInArrow`` with a function from columns as lists to columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings of the session for the jobs that run inside, put back at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the shuffle partitions of the session by a hash of keys."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pairs_of(df: DataFrame, left: str, right: str) -> DataFrame:
    """Links in both directions."""
    return df.select(left, right).unionAll(df.select(F.col(right).alias(left), F.col(left).alias(right)))
