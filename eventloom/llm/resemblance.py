"""Near copies by SimHash fingerprints and the Jaccard similarity of their sets of word
shingles.

Texts whose fingerprints (``simhash``) differ in few bits are linked. That reaches pairs
of a similarity near one; for the others, down to the least similarity, candidates are texts that share a band of minimum hashes: 32 bands of 4 miss a pair of
similarity 0.8 with a chance of 5e-8. Texts that candidates connect come together and
are verified on their exact sets of shingle hashes. All links together join the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, text_of, written
from eventloom.llm.linking import components
from eventloom.llm.prefixjoin import overlaps
from eventloom.llm.simhash import fingerprint, linked
from eventloom.llm.simhash import _signed as signed

BANDS, ROWS = 32, 4
#: texts and bytes of shingles of a block; larger groups are dealt out by pairs of blocks
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: shingles hashed at a time
SLICE = 1 << 14
_DRAW = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, words as in fingerprints."""
    w = text.encode("utf-8", "replace").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < size:
        return np.array([digest(join(w), 42)] if w else [], np.uint64)
    return np.unique(np.array([digest(join(t), 42) for t in zip(*(w[k:] for k in range(size)))], np.uint64))


def _bands(s: np.ndarray) -> list[int]:
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), SLICE):
            x = s[None, at : at + SLICE] * (_DRAW[0] | np.uint64(1))[:, None] + _DRAW[1][:, None]
            least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def links(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links whose groups are those of all pairs of similarity ``least`` or more."""
    n = np.array([len(s) for s in sets], np.int64)
    both = overlaps([s.view(np.int64) for s in sets])
    near = both + 1e-9 >= least * (n[:, None] + n[None, :] - both)
    out, left = [], np.ones(len(n), bool)
    for k in range(len(n)):
        if left[k]:
            left[k], front = False, [k]
            while front:
                reached = np.flatnonzero(near[front.pop()] & left).tolist()
                left[reached] = False
                front += reached
                out += [(ids[j], ids[k]) for j in reached]
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, bits: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, whose id is the smallest of their group of near
    copies: texts of fingerprints at most ``bits`` apart or a similarity of ``least``. Rows that repeat an id stay or go together; rows without an id stay; texts
    without words are copies of each other."""
    slim = df.select(F.col(id_col).cast("long").alias("_x_id"), text_of(text_col).alias("_x_text"), F.xxhash64(text_of(text_col)).alias("_x_t"))

    def sign(cols: dict) -> dict:
        sets = [shingles(t, size) for t in cols["_x_text"]]
        return {"id": cols["_x_id"], "t": cols["_x_t"], "d": [xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) for s in sets], "n": [len(s) for s in sets], "fp": [signed(fingerprint(t)) for t in cols["_x_text"]], "bands": [_bands(s) for s in sets]}

    arrow = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    rows = written(arrow_map(slim, sign, "id long, t long, d long, n long, fp long, bands array<long>", arrow))
    # fingerprints within the bits: each one's first set stands for it
    prints = written(rows.groupBy("fp").agg(F.min("d").alias("d")))
    held = rows.select("fp", "d").distinct().join(prints.withColumnRenamed("d", "b"), "fp").where("d <> b").select(F.col("d").alias("a"), "b")
    of = lambda side: prints.select(F.col("fp").alias(f"f{side}"), F.col("d").alias(side))
    alike = linked(prints.select("fp"), bits).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    printed = written(held.unionAll(alike.join(of("a"), "fa").join(of("b"), "fb").select("a", "b")))
    # equal sets are one kind
    kinds = written(rows.groupBy("d").agg(F.min("id").alias("id"), F.min("t").alias("t"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    keyed = kinds.select("d", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("d").alias("head"), F.count("*").alias("c")).where("c > 1")
    near = components(keyed.join(heads, "band").where("d <> head").select(F.col("d").alias("a"), F.col("head").alias("b")).distinct())
    near = near.unionAll(near.select(F.col("root").alias("node"), "root").distinct())
    members = written(kinds.select("d", "t", "n").join(near, F.col("d") == F.col("node")).select("d", "t", "n", "root"))
    texts = slim.select(F.col("_x_t").alias("t"), "_x_text").join(members, "t").groupBy("d", "root").agg(F.first("_x_text").alias("text"))
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = texts.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("d", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "d", "text")

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by("d")
        got = links(group.column("d").to_pylist(), [shingles(t, size) for t in group.column("text").to_pylist()], least)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    roots = components(printed.unionAll(dealt.groupBy("root", "i", "j").applyInArrow(verify, "a long, b long")))
    rooted = kinds.join(roots, F.col("d") == F.col("node"), "left").select("d", "id", F.coalesce("root", "d").alias("root"))
    named = rooted.groupBy("root").agg(F.min("id").alias("least"))
    gone = rows.join(rooted.select("d", "root"), "d").join(named, "root").where("id <> least").select(F.col("id").alias("_x_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_x_gone"], "left_anti")
