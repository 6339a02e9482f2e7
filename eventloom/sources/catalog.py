"""Sample catalog: which files belong to which channel."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.operators.scale import values_table


def read_catalog(spark: SparkSession, text: str, existing: DataFrame | None = None) -> DataFrame:
    """Catalog rows (channel, dir, name, path, pos, complete) from
    ``{"dir": {channel: path}, "file": {channel: [names]}}``.

    ``existing`` has the paths that are there; others are dropped and their
    channel is marked incomplete.
    """
    doc = json.loads(text)
    if "dir" not in doc or "file" not in doc:
        raise ValueError("a catalog needs the keys dir and file")
    rows = [
        (c, doc["dir"][c], n, doc["dir"][c].rstrip("/") + "/" + n, i)
        for c, names in doc["file"].items()
        if c in doc["dir"]
        for i, n in enumerate(names)
    ]
    cat = values_table(spark, "channel string, dir string, name string, path string, pos int", rows)
    if existing is None:
        return cat.withColumn("complete", F.lit(True))
    here = existing.select(F.col("path").alias("_p")).distinct()
    return mark_complete(cat.join(here, cat["path"] == here["_p"], "left").withColumn("_there", F.col("_p").isNotNull()))


def mark_complete(flagged: DataFrame) -> DataFrame:
    """Drop missing files, keep per channel whether all were there. One row per
    file, and a channel's flag is an aggregate joined back."""
    flags = flagged.groupBy("channel").agg(F.bool_and("_there").alias("complete"))
    return flagged.filter("_there").join(flags, "channel").drop("_p", "_there")


def channel_files(catalog: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Files of some channels; unknown names are skipped."""
    return catalog.filter(F.col("channel").isin(*channels))


def match_channels(catalog: DataFrame, patterns: Sequence[str], regex: bool = False) -> list[str]:
    """Channels that match wildcard (or regular) patterns, in pattern order and
    once each; a pattern without a match is an error. The channel list is
    configuration size."""
    import re

    known = sorted(r["channel"] for r in catalog.select("channel").distinct().collect())
    out: dict[str, None] = {}
    for p in patterns:
        hits = [c for c in known if (re.search(p, c) if regex else fnmatch.fnmatchcase(c, p))]
        if not hits:
            raise ValueError(f"pattern {p} matches no channel")
        out.update(dict.fromkeys(hits))
    return list(out)


def switch_channels(names: Sequence[str], on: Sequence[str] = (), off: Sequence[str] = ()) -> list[str]:
    """Apply turn-on and turn-off regular expressions to a channel list."""
    import re

    keep = [n for n in names if not on or any(re.search(p, n) for p in on)]
    return [n for n in keep if not any(re.search(p, n) for p in off)]


def cap_files(catalog: DataFrame, n: int) -> DataFrame:
    """First n files per channel. The catalog has one row per file."""
    w = Window.partitionBy("channel").orderBy("path")
    return catalog.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def name_channels(paths: DataFrame, path: str, names: dict[str, str], rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Channel of a path: the dictionary by dataset folder, else the first
    matching pattern rule, else NULL."""
    folder = F.regexp_extract(path, r"^/?([^/]+)", 1)
    known = None
    for key, value in names.items():
        known = F.when(folder == key, F.lit(value)) if known is None else known.when(folder == key, F.lit(value))
    ruled = None
    for pattern, value in rules:
        cond = F.col(path).rlike(pattern)
        ruled = F.when(cond, F.lit(value)) if ruled is None else ruled.when(cond, F.lit(value))
    parts = [p for p in (known, ruled) if p is not None]
    return paths.withColumns({"folder": folder, "channel": F.coalesce(*parts)})


def unknown_folders(named: DataFrame) -> DataFrame:
    return named.filter(F.col("channel").isNull()).groupBy("folder").agg(F.count(F.lit(1)).alias("n_paths"))


def read_channels(spark: SparkSession, catalog: DataFrame, schema: StructType | None = None) -> DataFrame:
    """All files of a catalog as one event table with channel and source file.

    One scan over all paths, which Spark's reader takes as a list; the channel comes
    from a join of the file name with the catalog itself, so the plan does not grow
    with the number of channels. Without a ``schema`` those of all files are merged.
    """
    paths = [r["path"] for r in catalog.select("path").distinct().toLocalIterator()]
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    events = reader.parquet(*paths)
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    events = events.withColumns({"_file": file, "_dir": F.regexp_replace(file, "/[^/]+$", "")})
    names = catalog.select("channel", F.rtrim("path", F.lit("/")).alias("source_file"))
    # a catalog path is a single file or a folder of part files
    one = names.select(F.col("source_file").alias("_file"), F.col("channel").alias("_c1"))
    many = names.select(F.col("source_file").alias("_dir"), F.col("channel").alias("_c2"))
    out = events.join(one, "_file", "left").join(many, "_dir", "left")
    source = F.when(F.col("_c1").isNotNull(), F.col("_file")).otherwise(F.col("_dir"))
    return out.withColumns({"channel": F.coalesce("_c1", "_c2"), "source_file": source}).drop("_file", "_dir", "_c1", "_c2")


def output_name(path):
    """Name of the output of one input: parent folder, a dash, base name."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1), "/", "-")


def pending(inputs: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Inputs without a valid output."""
    done = manifest.filter("valid").select(key)
    return inputs.join(done, key, "left_anti")


def chunked(catalog: DataFrame, per_chunk: int) -> DataFrame:
    """Number the files of a channel in chunks of k inputs."""
    w = Window.partitionBy("channel").orderBy("path")
    return catalog.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / per_chunk).cast("int"))
