"""Packing of token sequences by best-fit decreasing.

Documents become token ids; longer ones are first cut into full windows, which are
sequences of their own. What remains is dealt by a hash into groups of bounded size;
each group is packed from its longest piece down into the tightest open sequence,
found in a segment tree over remaining capacity.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import text_of
from eventloom.llm.tokens import encoder_of

#: tokens of a sequence
WINDOW = 2048
#: documents packed together
GROUP_ROWS = 1 << 14
END = 1


class OpenSequences:
    """Open sequences by remaining capacity: a segment tree of counts finds the
    smallest capacity that holds a piece."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.held: dict[int, list[int]] = {}

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, capacity: int, sequence: int) -> None:
        if capacity:
            self.held.setdefault(capacity, []).append(sequence)
            self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Capacity and number of the tightest sequence for ``length``, taken out."""
        at = length + self.size
        while not self.tree[at]:
            while at & 1:  # a right child: its parent has nothing further right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._change(capacity, -1)
        return capacity, self.held[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Sequence and offset of each piece; ``lengths`` must not increase."""
    open_, used, out = OpenSequences(window), 0, []
    for n in lengths:
        found = open_.take(n)
        if found is None:
            found, used = (window, used), used + 1
        out.append((found[1], window - found[0]))
        open_.add(found[0] - n, found[1])
    return out


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, window: int, end: int, with_ids: bool) -> DataFrame:
    """Documents as token ids with the end id, cut into full windows and a rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
    last = end.to_bytes(4, "little")

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.one(text) + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    row = [doc, start, len(part) // 4, zlib.crc32(part), total] + [part] * with_ids
                    for c, x in zip(cols, row):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, schema)


def packed(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``, and ``ids`` (little-endian unsigned 32-bit) if asked for.

    Null and empty texts are the end id alone. Rows that repeat an id are packed each.
    Pieces of equal length are taken by id, then start. Sequence numbers hold the group
    in their upper bits. An empty table gives an empty result.
    """
    groups = max(1, -(-df.count() // group_rows))
    found = pieces(df, tokenizer, id_col, text_col, window, end, with_ids)
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        base = group.column("group")[0].as_py() << 32
        spots = best_fit(group.column("length").to_pylist(), window)
        group = group.drop_columns(["group"])
        return group.append_column("sequence_id", pa.array([base + s for s, _ in spots], pa.int64())).append_column("offset", pa.array([o for _, o in spots], pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(pack, schema)
