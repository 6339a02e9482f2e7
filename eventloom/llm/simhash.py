"""Near duplicates by SimHash fingerprints in vantage-point trees.

Fingerprints (64 bits of word shingles) are grouped first: equal ones are one
point. A tree of vantage points, drawn from a bounded sample, divides the points
into shards: a point within ``mu`` of the vantage point goes inside, else outside,
and an outside point within ``mu + bits`` goes inside as well, because a point that
it links to may be there (triangle bound). Hence two points at most ``bits`` apart
meet in at least one shard. Inside a shard the division goes on by the same bound
down to small leaves, where distances are counted. A shard reports a star per
group of linked points, never all pairs; the stars are joined into components.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, written
from eventloom.llm.linking import components

#: distinct fingerprints from which vantage points are drawn
TREE_SAMPLE = 4096
#: points that a shard should hold, copies at boundaries included
SHARD_POINTS = 1 << 16
#: points of one task at most; a larger shard is dealt out by pairs of blocks
BLOCK_POINTS = 200_000
#: points of a leaf in a shard
LEAF_POINTS = 512
#: shingles hashed at a time
SLICE = 1 << 18


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word shingles, repeats
    included. Letters A-Z are lower-cased, words end at ASCII white space; fewer
    words than a shingle are one shingle, no word gives zero."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    total, counts = len(w) - shingle + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, SLICE):
        part = w[at : at + SLICE + shingle - 1]
        h = np.array([digest(join(t), 42) for t in zip(*(part[k:] for k in range(shingle)))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, fp``: the fingerprint of every row as a signed long."""
    kind = df.schema[id_col].dataType
    if kind.simpleString() != "bigint":
        df = df.withColumn(id_col, F.col(id_col).cast("long"))

    def run(cols: dict) -> dict:
        return {"_x_id": cols["_x_id"], "_x_fp": [_signed(fingerprint(t, shingle)) for t in cols["_x_text"]]}

    slim = df.select(F.col(id_col).alias("_x_id"), F.col(text_col).alias("_x_text"))
    out = arrow_map(slim, run, "_x_id long, _x_fp long", pa.schema([("_x_id", pa.int64()), ("_x_fp", pa.int64())]))
    return out.select(F.col("_x_id").alias(id_col), F.col("_x_fp").alias("fp"))


def _apart(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def plan_tree(sample: list[int], expected: float, target: int, bits: int, seed: int = 7) -> list:
    """Inner nodes as ``[vantage, mu, inside, outside]``, leaves as None. A node is
    divided while the points expected in it, boundary copies included, exceed the
    target; where the sample has run out, vantage points are drawn from all of it
    and the radius is that of random fingerprints."""
    draw, whole = random.Random(seed), np.array(sample, np.uint64)

    def grow(part: np.ndarray, expected: float, depth: int) -> list | None:
        if expected <= target or depth >= 24 or not len(whole):
            return None
        known = len(part) >= 64
        vantage = np.uint64(draw.choice(part.tolist() if known else whole.tolist()))
        d = _apart(part, vantage)
        mu = int(np.median(d)) if known else 31
        near, far = d <= mu + bits, d > mu
        if known:
            share_in, share_out = near.mean(), far.mean()
        else:
            share_in, share_out = 0.81, 0.55
        if share_in > 0.97:  # a dense group: distances do not divide it
            return None
        return [int(vantage), mu, grow(part[near], expected * share_in, depth + 1), grow(part[far], expected * share_out, depth + 1)]

    return grow(whole, expected, 0)


def _deal(tree: list | None, points: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Leaf numbers with the indices of the points that belong there."""
    out, todo = [], [(tree, np.arange(len(points)), 1)]
    while todo:
        node, idx, no = todo.pop()
        if node is None:
            if len(idx):
                out.append((no, idx))
            continue
        d = _apart(points[idx], np.uint64(node[0]))
        todo.append((node[2], idx[d <= node[1] + bits], 2 * no))
        todo.append((node[3], idx[d > node[1]], 2 * no + 1))
    return out


def _stars(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a leaf: each linked point with the first of its group, found by
    growing groups from their unvisited neighbours."""
    linked = np.zeros(len(points), bool)
    for at in range(0, len(points), 256):
        close = np.bitwise_count(points[at : at + 256, None] ^ points[None, :]) <= bits
        linked[at : at + 256] = close.sum(1) > 1
    left, out = points[linked], []
    while len(left):
        first, front, left = int(left[0]), left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                hit |= (np.bitwise_count(front[at : at + 256, None] ^ left[None, :]) <= bits).any(0)
            front, left = left[hit], left[~hit]
            out.extend((int(x), first) for x in front)
    return out


def links_within(points: np.ndarray, bits: int, leaf: int = LEAF_POINTS) -> set[tuple[int, int]]:
    """Links whose components are those of all pairs of ``points`` (distinct) at
    most ``bits`` apart: vantage points down to leaves."""
    out: set[tuple[int, int]] = set()
    todo = [points]
    while todo:
        part = todo.pop()
        if len(part) > leaf:
            d = _apart(part, part[len(part) // 2])
            mu = int(np.median(d))
            near, far = d <= mu + bits, d > mu
            if near.mean() < 0.97:
                todo += [part[near], part[far]]
                continue
        if len(part) > 1:
            out.update(_stars(part, bits))
    return out


def linked(points: DataFrame, bits: int = 3, tree_sample: int = TREE_SAMPLE, shard_points: int = SHARD_POINTS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect
    exactly those which pairs at most ``bits`` apart connect."""
    spark = points.sparkSession
    n = points.count()
    sample = [r["fp"] & (2**64 - 1) for r in points.orderBy(F.xxhash64("fp"), "fp").limit(tree_sample).collect()]
    tree = plan_tree(sample, n, shard_points, bits)

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            got = _deal(tree, fp.view(np.uint64), bits)
            if got:
                shard = np.concatenate([np.full(len(i), no, np.int64) for no, i in got])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.concatenate([fp[i] for _, i in got]))], names=["shard", "fp"])

    dealt = written(points.select("fp").mapInArrow(deal, "shard long, fp long"))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block_points).cast("int").alias("blocks"))
    # a shard in one block is the pair of blocks (0, 0)
    own = dealt.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    keyed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )

    def search(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy().astype(np.int64)).view(np.uint64)
        got = sorted(links_within(fp, bits))
        a = np.array([x for x, _ in got], np.uint64).view(np.int64)
        b = np.array([y for _, y in got], np.uint64).view(np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return keyed.groupBy("shard", "i", "j").applyInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links of at most ``bits`` differing
    bits, itself included).

    Null and empty texts have fingerprint zero and are linked like any other. Rows
    without an id take part in linking but are never the smallest; a component of
    such rows only has a null id. Repeated rows and ids each get their row. An empty
    table gives an empty result.
    """
    fps = written(fingerprints(df, id_col, text_col, shingle).select(F.col(id_col).alias("_x_id"), "fp"))
    points = written(fps.groupBy("fp").agg(F.min("_x_id").alias("least")))
    roots = components(linked(points, bits))
    rooted = written(points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        F.col("_x_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, whose id is the smallest of their component.
    Rows that repeat an id stay or go together; rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, shingle, bits)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_x_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_x_gone"], "left_anti")
