"""Token ids of a corpus as compressed blocks with an index, for access by document.

The store is two tables in one folder, so any file system that Spark writes will do
and a repeated task leaves no second copy. ``dictionary`` has one zstandard
dictionary, trained on the serialized ids of a bounded sample. ``blocks`` holds the
documents in ascending id order: per block its ``shard`` and ``block`` number, the
first and last id, the hash of the dictionary, the ids of its documents, their token
counts, the offsets of their frames and the ``payload``: one frame per document,
compressed by itself, so a short document is read without its neighbours.
Ids are little-endian, of two bytes where the vocabulary allows it, else of four.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from eventloom.llm.common import text_of
from eventloom.llm.tokens import encoder_of

#: documents on which the dictionary is trained, and its size at most
SAMPLE_ROWS, DICTIONARY_BYTES = 2000, 112_640
#: compressed bytes, and documents, of a block
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 4096
LEVEL = 3
END = 2

_BLOCK = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary_hash", pa.string()), ("width", pa.int32()),
        ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)
_BLOCK_SQL = (
    "shard int, block int, first_id long, last_id long, dictionary_hash string, width int, "
    "tokens long, ids array<long>, counts array<long>, offsets array<long>, payload binary"
)


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _wide(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if width == 2 else data


def _encoded(df: DataFrame, tokenizer: str, end: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = encoder_of(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            out = [_narrow(encoder.one(t) + last, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return df.mapInArrow(run, "ids binary")


def train_dictionary(df: DataFrame, tokenizer: str, id_col: str, text_col: str, end: int, width: int) -> bytes:
    """From at most ``SAMPLE_ROWS`` documents, the first by a hash of their id; empty
    if these are too few or too short for a dictionary."""
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    picked = docs.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = sorted(bytes(r["ids"]) for r in _encoded(docs.join(picked, "id").select("text"), tokenizer, end, width).collect())
    size = min(DICTIONARY_BYTES, sum(map(len, rows)) // 10)
    if len(rows) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:  # nothing recurs in the sample
        return b""


def write_ids(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Write the store. Null and empty texts are the end id alone; rows without an id
    come first; rows that repeat an id are in the order of their texts' hashes."""
    spark = df.sparkSession
    width = 2 if encoder_of(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4
    data = train_dictionary(df, tokenizer, id_col, text_col, end, width)
    name = xxhash.xxh64_hexdigest(data)
    schema = StructType([StructField("dictionary_hash", StringType()), StructField("data", BinaryType())])
    spark.createDataFrame([(name, bytearray(data))], schema).coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        encoder, last = encoder_of(tokenizer), end.to_bytes(4, "little")
        shared = zstandard.ZstdCompressionDict(data) if data else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        ids, counts, frames, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [shard, block, min(known, default=None), max(known, default=None), name, width, sum(counts), ids, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = _narrow(encoder.one(text) + last, width)
                ids.append(doc)
                counts.append(len(raw) // width)
                frames.append(packer.compress(raw))
                held += len(frames[-1])
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield flush()
                    ids, counts, frames, held, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    docs = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(shards, "id").sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, _BLOCK_SQL).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if xxhash.xxh64_hexdigest(data) != row["dictionary_hash"]:
        raise ValueError(f"the dictionary in {path} is damaged")
    return row["dictionary_hash"], data


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the store: ``doc_id, start`` (ids of all documents before
    it)``, n_tokens, ids_crc32``, and ``ids`` (little-endian unsigned 32-bit)."""
    name, data = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("total"))
    # one row per shard, that is per partition of the writer
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("block")
    placed = blocks.select("shard", "block", (F.sum("tokens").over(inside) - F.col("tokens")).alias("inside")).join(before, "shard")
    starts = placed.select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != name:
                    raise ValueError("a block was written with another dictionary")
                cols: list[list] = [[] for _ in names]
                at, payload, off = row["start"], memoryview(row["payload"]), row["offsets"]
                for k, (doc, n) in enumerate(zip(row["ids"], row["counts"])):
                    ids = _wide(opener.decompress(payload[off[k] : off[k + 1]]), row["width"])
                    for c, x in zip(cols, [doc, at, n, zlib.crc32(ids)] + [ids] * with_ids):
                        c.append(x)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    full = blocks.join(starts, ["shard", "block"]).select("dictionary_hash", "width", "ids", "counts", "offsets", "payload", "start")
    return full.mapInArrow(run, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id (none, one, or the repeated ones). Only the
    blocks whose range holds the id are read, and only its frames are opened."""
    name, data = _dictionary(spark, path)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    here = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    hit = here.select("shard", "block", "width", "payload", "offsets", F.posexplode("ids").alias("k", "doc")).where(F.col("doc") == doc_id)
    # substring counts from 1
    frame = F.expr("substring(payload, CAST(offsets[k] AS INT) + 1, CAST(offsets[k + 1] - offsets[k] AS INT))")
    rows = hit.select("shard", "block", "k", "width", frame.alias("frame")).orderBy("shard", "block", "k").collect()
    return [np.frombuffer(_wide(opener.decompress(bytes(r["frame"])), r["width"]), "<u4").tolist() for r in rows]
