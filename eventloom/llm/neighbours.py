"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are divided into bands of about equal norm. Those of a band are scaled into
the unit ball by its upper end and given one more coordinate that makes them unit
vectors, so that the nearest by angle are the largest by inner product; the bands keep
that coordinate small. Bands of few vectors are scored whole. In the others a
pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns the vectors, and the nearest signed axis is the bucket in a table. A query visits, in every
table, the buckets of its nearest signed axes, and everything in them is scored
exactly. A first visit of the nearest bucket of each table gives every query a lower
bound for what can still count; bands that lie below it are left out. A query that has
met fewer vectors than it may name is scored against all. Equal vectors are indexed once, with the smallest of
their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: rotations, and buckets that a query visits in each; by measurement these give a
#: recall above 0.9 even for vectors drawn evenly from the sphere in 64 dimensions
TABLES, PROBES = 6, 48
NEAREST = 20
#: vectors of a bucket that one task scores at a time
BLOCK = 8192
#: ratio of the norms at the ends of a band, and vectors of a band that is scored whole
BAND, FEW = 1.15, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int = 3) -> np.ndarray:
    """Pseudo-rotation number ``table``; rows are padded to a power of two."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, d]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first: ``2 * axis``, plus
    one on the negative side."""
    y = rotated(x, table)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    count = min(count, both.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def unit_rows(x: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Rows over ``upper``, completed to unit length by one more coordinate."""
    x = x / upper[:, None]
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _bucketed(df: DataFrame, width: int, probes: int, tables: int, query: bool) -> DataFrame:
    """Rows ``cid, v`` and ``band, upper`` (of a query ``bound, norm``) once per visited
    bucket, with ``tab, bucket``."""
    names = ["cid", "v", *(("bound", "norm") if query else ("band", "upper"))]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            if query:
                x = np.hstack([x / np.sqrt((x * x).sum(1))[:, None], np.zeros((len(x), 1))])
            else:
                x = unit_rows(x, batch.column(3).to_numpy())
            for tab in range(tables):
                axes = nearest_axes(x, tab, probes)
                rows = pa.array(np.repeat(np.arange(len(x)), axes.shape[1]))
                cols = [*(batch.column(k).take(rows) for k in range(len(names))), pa.array(np.full(len(rows), tab, np.int32)), pa.array(axes.ravel().astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "tab", "bucket"])

    kind = df.schema["v"].dataType.simpleString()
    more = "bound double, norm double" if query else "band long, upper double"
    return df.select(*names).mapInArrow(run, f"cid long, v {kind}, {more}, tab int, bucket int")


def _scored(width: int, nearest: int):
    def score(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and found.num_rows:
            q, x = _matrix(queries.column("v"), width), _matrix(found.column("v"), width)
            qid, xid = queries.column("cid").to_numpy(), found.column("cid").to_numpy()
            bound = queries.column("bound").to_numpy()
            k = min(nearest, len(x))
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                s = part @ x.T
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(part)), k)
                # the score itself is the same wherever the pair meets
                exact = np.einsum("ij,ij->i", part[rows], x[top.ravel()])
                fit = exact >= bound[at + rows]
                for c, v in zip(out, (qid[at + rows], xid[top.ravel()], exact)):
                    c.append(v[fit])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"qid": pa.array(cols[0].astype(np.int64)), "cid": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    return score


def _whole(found: DataFrame, queries: DataFrame, width: int, nearest: int) -> DataFrame:
    """Every query (``cid, v, bound``) against every row of ``found``, in blocks."""
    count = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int")
    i = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    j = F.pmod(F.xxhash64("cid"), F.col("asking")).cast("int")
    cut = written(found.agg(count.alias("blocks")).crossJoin(queries.agg(count.alias("asking"))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.crossJoin(cut).withColumn("j", j).withColumn("i", each("blocks")).select("i", "j", "cid", "v", "bound")
    right = found.crossJoin(cut).withColumn("i", i).withColumn("j", each("asking")).select("i", "j", "cid", "v")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_scored(width, nearest + 1), "qid long, cid long, score double")


def _of_width(kinds: DataFrame, asked: DataFrame, width: int, longest: float, nearest: int, tables: int, probes: int, few: int) -> DataFrame:
    """Largest inner products between distinct queries and distinct vectors."""
    # norms that differ by rounding only do not part at the ends of a band
    step = F.floor(F.log(F.lit(longest) / _norm("v")) / float(np.log(BAND)) + 1e-4).cast("long")
    banded = written(kinds.select("cid", "v", F.greatest(step, F.lit(0)).alias("band")))
    bands = written(banded.groupBy("band").agg(F.count("*").alias("of_band"), F.max(_norm("v")).alias("upper")))
    banded = banded.join(bands, "band")
    small = banded.where(F.col("of_band") <= few).select("cid", "v")
    found = _bucketed(banded.where(F.col("of_band") > few), width, 1, tables, False)
    # a crowded bucket is dealt out in blocks, which all of its queries visit
    at = ["band", "tab", "bucket"]
    sizes = written(found.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("upper").alias("upper")))
    found = found.join(sizes.drop("upper"), at).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).drop("blocks")
    keys = (*at, "block")

    def visit(queries: DataFrame, count: int) -> DataFrame:
        visits = _bucketed(queries.withColumn("norm", _norm("v")), width, count, tables, True).join(sizes, ["tab", "bucket"])
        visits = visits.where(F.col("norm") * F.col("upper") * (1 + 1e-9) >= F.col("bound"))
        visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "upper", "norm")
        return visits.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(_scored(width, nearest + 1), "qid long, cid long, score double")

    def joined(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("qid", "cid").agg(F.max("score").alias("score"))

    free = asked.withColumn("bound", F.lit(float("-inf")))
    first = written(_whole(small, free, width, nearest))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    near = joined(visit(free, 1).unionAll(first))
    last = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1).where(F.col("n") == nearest + 1)
    bounds = last.select(F.col("qid").alias("cid"), F.col("score").alias("bound"))
    bounded = written(asked.join(bounds, "cid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))))
    pairs = written(joined(visit(bounded, probes).unionAll(first)))
    full = pairs.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > nearest).select(F.col("qid").alias("cid"))
    # where all vectors are few, all have been scored
    short = written(free.join(full, "cid", "left_anti").crossJoin(bands.agg(F.max("of_band").alias("most"))).where(F.col("most") > few).drop("most"))
    return joined(pairs.unionAll(_whole(banded.select("cid", "v"), short, width, nearest)))


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", nearest: int = NEAREST, tables: int = TABLES, probes: int = PROBES, few: int = FEW) -> DataFrame:
    """The ``nearest`` rows of each row where ``is_query``, itself left out:
    ``query_id, rank, vec_id, score``, largest inner product first, ties to smaller
    ids; a query gets fewer rows only if there are fewer candidates.

    Vectors that are null, zero, or hold a null or a number that is not finite take no
    part, nor do rows without an id. Vectors of different lengths are not compared.
    Rows that repeat an id are one candidate per distinct vector, and a row is never a
    neighbour of its own id. An empty table gives an empty result.
    """
    rows = df.where(F.col(id_col).isNotNull() & _usable(F.col(vec_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # of equal vectors no more than nearest + 1 ids can appear in one answer
    first = Window.partitionBy("v").orderBy("id")
    named = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= nearest + 1)
    kinds = written(named.groupBy("v").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids")))
    # a vector that has the smallest id of several kinds would name them alike
    kinds = written(kinds.withColumn("cid", F.xxhash64("v", "cid")))
    asked = rows.where("asks").select("id", "v").distinct()
    asks = written(asked.join(kinds.select("v", "cid"), "v").select("id", "cid"))
    wanted = kinds.join(asks.select("cid").distinct(), "cid", "left_semi")
    shapes = kinds.groupBy(F.size("v").alias("width")).agg(F.max(_norm("v")).alias("longest")).collect()
    empty = kinds.select(F.col("cid").alias("qid"), "cid", F.lit(0.0).alias("score")).limit(0)
    pairs = empty
    for s in sorted(shapes):
        fits = F.size("v") == s["width"]
        pairs = pairs.unionAll(_of_width(kinds.where(fits), wanted.where(fits), s["width"], s["longest"], nearest, tables, probes, few))
    # more kinds than one answer needs, so that ties at the end are decided by id
    top = written(pairs.withColumn("n", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("n") <= nearest + 1))
    named = top.join(kinds.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    listed = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1)
    answers = asks.join(listed, asks["cid"] == listed["qid"]).where("id <> vec_id").groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= nearest)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
