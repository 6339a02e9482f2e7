"""From flat parent and child tables to events with collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_children(children: DataFrame, key: str, order: Sequence[str], fields: dict[str, Column], name: str) -> DataFrame:
    """One row per key with the children as an ordered array of structs.

    An event is one row by the data model, so a key's children fit in a row. Only the needed fields are collected. The result is
    hash-partitioned by the key, which a following join on it reuses.
    """
    items = F.struct(*[F.col(o).alias(f"_{o}") for o in order], *[c.alias(f) for f, c in fields.items()])
    packed = children.groupBy(key).agg(F.sort_array(F.collect_list(items)).alias("_all"))
    clean = F.transform("_all", lambda o: F.struct(*[o[f].alias(f) for f in fields]))
    return packed.select(key, clean.alias(name))


def attach(parents: DataFrame, key: str, children: DataFrame, name: str) -> DataFrame:
    """Left join of a collection; a parent without children gets an empty one."""
    kind = children.schema[name].dataType
    return parents.join(children, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def from_parallel_arrays(df: DataFrame, prefix: str, name: str | None = None, drop: bool = True) -> DataFrame:
    """Parallel arrays ``<prefix>_<field>`` to one array of structs, with the
    count ``n<prefix>`` if it is not there."""
    cols = [c for c in df.columns if c.startswith(prefix + "_") and df.schema[c].dataType.typeName() == "array"]
    fields = [c[len(prefix) + 1 :] for c in cols]
    zipped = F.transform(F.arrays_zip(*cols), lambda o: F.struct(*[o[c].alias(f) for c, f in zip(cols, fields)]))
    out = df.withColumn(name or prefix, zipped)
    if f"n{prefix}" not in df.columns:
        out = out.withColumn(f"n{prefix}", F.size(name or prefix))
    return out.drop(*cols) if drop else out
