"""Removal of byte strings that occur more than once, by sorting suffixes.

A window is a string of ``length`` bytes. Every window is represented by the least
hash among the ``GRAM``-byte strings in it (its anchor); neighbouring windows mostly
share an anchor and form a run. Equal windows have equal anchors at equal distance, so

1. runs whose anchor occurs once in the corpus are done: nothing in them repeats;
2. runs whose whole text occurs again are done: all of their windows repeat;
3. the others, at the ends of repeated passages, are compared by a suffix sort. One
   text of each kind is fetched, and per anchor the suffixes that begin at the same
   distance are ordered by a merge sort. Two suffixes are compared by the longest
   common extension, found by binary search over prefix polynomial hashes, hence in a
   logarithmic number of steps; neighbours in the order then tell which windows
   repeat. Halving the range of distances keeps the sorted suffixes few. Equal
   hashes are verified on the bytes.

An anchor with more distinct runs than one task should hold is counted by its
windows' hashes instead, over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import text_of, written

#: bytes of a repeated string
LENGTH = 400
#: bytes of an anchor
GRAM = 64
#: bytes hashed at a time
SLICE = 1 << 20
#: distinct runs of an anchor that one task sorts
GROUP_RUNS = 2048

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([b]), 5) | 1 for b in range(256)], np.uint64)


class Polynomial:
    """Prefix hashes modulo 2**64 over random letters; equal strings have equal
    hashes, and claims of equality are verified by their users."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if Polynomial._powers is None or len(Polynomial._powers[0]) < n:
            up = np.full(max(n, SLICE + 4096), _BASE, np.uint64)
            down = np.full(len(up), pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                Polynomial._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = Polynomial._powers
        self.prefix = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_LETTERS[data] * up[: n - 1], out=self.prefix[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        """Hashes of the strings of ``length`` at ``at``."""
        with np.errstate(over="ignore"):
            return (self.prefix[at + length] - self.prefix[at]) * self.down[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
        return x ^ (x >> _U(27))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: prefixes and suffixes of blocks."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = y.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def _runs_of(data: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows that lie between neighbouring ``bounds``: first window,
    number of windows, distance of the anchor from the first window, its hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(len(raw) - GRAM + 1)
    hashes = _mixed(Polynomial(raw).of(at, GRAM))
    mask = _U((1 << 31) - 1)
    least = _sliding_min((hashes & ~mask) | at.astype(np.uint64), length - GRAM + 1) & mask
    least = least.astype(np.int64)
    last_window = np.repeat(bounds[1:] - length, np.diff(bounds))[: len(least)]
    begin = np.repeat(bounds[:-1], np.diff(bounds))[: len(least)]
    here = np.arange(len(least))
    valid = here <= last_window
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (begin[1:] != begin[:-1])
    first = np.flatnonzero(new)
    # windows of a text are contiguous, so a run ends before the next or with its text
    nxt = np.append(first[1:], len(least))
    count = np.minimum(nxt, last_window[first] + 1) - first
    return first, count, least[first] - first, hashes[least[first]]


_RUN = "id long, th long, a long, u long, lo long, n int, d int"
_RUN_ARROW = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("u", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("d", pa.int32())])


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of all documents (``id, th, text``): ``lo`` first window, ``n`` windows,
    ``d`` bytes from there to the anchor, hashes ``a`` of the anchor, ``u`` of the
    text of the run."""

    def parts(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes]]]:
        """Documents gathered into slices; long ones are cut so that each window is
        in one part."""
        held, size = [], 0
        for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode("utf-8", "replace")
            for at in range(0, max(0, len(raw) - length + 1), SLICE):
                part = raw[at : at + SLICE + length - 1]
                held.append((i, t, at, part))
                size += len(part)
                if size >= SLICE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in parts(batch):
                data = b"".join(x[3] for x in held)
                bounds = np.concatenate([[0], np.cumsum([len(x[3]) for x in held])])
                first, count, dist, anchor = _runs_of(data, bounds, length)
                doc = np.searchsorted(bounds, first, "right") - 1
                view, digest = memoryview(data), xxhash.xxh3_64_intdigest
                whole = np.array([digest(view[s : s + k + length - 1]) for s, k in zip(first.tolist(), count.tolist())], np.uint64)
                ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(doc))
                shift = np.array([x[2] for x in held]) - bounds[:-1]
                cols = [ids, np.array([x[1] for x in held])[doc], anchor.view(np.int64), whole.view(np.int64), first + shift[doc], count.astype(np.int32), dist.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=_RUN_ARROW)

    return docs.mapInArrow(run, _RUN)


def extension(poly: Polynomial, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at ``a`` and ``b``, up to ``most``."""
    lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = poly.of(a, mid) == poly.of(b, mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def sorted_suffixes(poly: Polynomial, data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``data[at : at + size]`` within each group (``group`` does
    not decrease): merge sort from below, all groups at once. The place of a suffix in
    the sibling block is found by binary search, each step one comparison by common
    extension."""
    order = np.arange(len(at))
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")
    width, largest = 1, int((end - begin).max(initial=0))
    while width < largest:
        slot = np.arange(len(at))
        block = (slot - begin) // width
        odd = (block & 1).astype(bool)
        mine = begin + block * width
        other = np.where(odd, mine - width, mine + width)
        other_end = np.minimum(other + width, end)
        pair = np.where(odd, other, mine)
        lo, hi = other.copy(), np.maximum(other, other_end)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            x, y = order[open_], order[mid]
            most = np.minimum(size[x], size[y])
            k = extension(poly, at[x], at[y], most)
            inside = k < most
            cx = np.where(inside, data[np.minimum(at[x] + k, len(data) - 1)], 0).astype(np.int64)
            cy = np.where(inside, data[np.minimum(at[y] + k, len(data) - 1)], 0).astype(np.int64)
            cx, cy = np.where(inside, cx, size[x]), np.where(inside, cy, size[y])
            # equal suffixes keep their order: those of the left block come first
            before = np.where(odd[open_], cy <= cx, cy < cx)
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        place = pair + (slot - mine) + (lo - other)
        new = np.empty_like(order)
        new[place] = order
        order, width = new, 2 * width
    return order


def _classes(poly, data, at, size, group) -> np.ndarray:
    """Class numbers of equal strings of equal size in a group, verified on the bytes:
    a suffix that shares all its bytes with its neighbour in the order joins it."""
    by = np.lexsort((size, group))
    g = group[by] * 4096 + size[by]
    order = by[sorted_suffixes(poly, data, at[by], size[by], g)]
    x, y = order[:-1], order[1:]
    k = (group[x] == group[y]) & (size[x] == size[y])
    idx = np.flatnonzero(k)
    k[idx] = extension(poly, at[x[idx]], at[y[idx]], size[x[idx]]) == size[x[idx]]
    view = data.data
    for i in np.flatnonzero(k).tolist():
        p, q, n = int(at[x[i]]), int(at[y[i]]), int(size[x[i]])
        k[i] = view[p : p + n] == view[q : q + n]
    out = np.empty(len(at), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~k)]) if len(order) else []
    return out


def repeated_windows(texts: list[bytes], group: np.ndarray, anchor: np.ndarray, count: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``run, first window, windows``: the windows of each run that another run of its
    group has at the same distance from the anchor. ``group`` does not decrease."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    poly = Polynomial(data)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1].astype(np.int64)
    point = base + anchor  # of the anchors
    run = np.arange(len(texts))
    lo = np.zeros(len(texts), np.int64)  # distances lo <= d < lo + width, a power of two
    width = 1 << int(max(length - GRAM, 1)).bit_length()
    far, near = anchor, anchor - count + 1  # distances of the first and the last window
    out = []
    while len(run):
        top = np.minimum(lo + width - 1, far[run])
        low = np.maximum(lo, near[run])
        held = top >= low
        run, lo, top, low = run[held], lo[held], top[held], low[held]
        if not len(run):
            break
        # what all windows of the range share: nobody else has it, nobody else has them
        where = np.unique(np.stack([group[run], lo]), axis=1, return_inverse=True)[1].ravel()
        core = _classes(poly, data, point[run] - lo, np.full(len(run), max(0, length - width + 1)), where)
        shared = np.bincount(core)[core] > 1
        run, lo, top, low, core = run[shared], lo[shared], top[shared], low[shared], core[shared]
        if not len(run):
            break
        # what they cover together: if another has it, all of them repeat
        where = np.unique(np.stack([core, top, low]), axis=1, return_inverse=True)[1].ravel()
        cover = _classes(poly, data, point[run] - top, top - low + length, where)
        same = np.bincount(cover)[cover] > 1
        out += [(int(r), int(far[r] - t), int(t - b + 1)) for r, t, b in zip(run[same], top[same], low[same])]
        # one of the same goes on as long as others, still open, may have parts of it
        _, keep = np.unique(cover, return_index=True)
        single = np.zeros(len(run), bool)
        single[keep] = True
        run, lo, core, open_ = run[single], lo[single], core[single], ~same[single]
        alive = (np.bincount(core, open_)[core] > 0) & (np.bincount(core)[core] > 1)
        run, lo = run[alive], lo[alive]
        if width == 1:
            break
        width //= 2
        run, lo = np.concatenate([run, run]), np.concatenate([lo, lo + width])
    return out


_FOUND = "id long, th long, lo long, hi long"
_FOUND_ARROW = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The texts of the runs in ``wanted``, cut out of their documents."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("a", "lo", "n", "d", "k")).alias("runs"))
    lists = lists.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), "runs")
    joined = docs.join(lists.hint("shuffle_hash"), docs["id"].eqNullSafe(lists["r_id"]) & (docs["th"] == lists["r_th"]))
    # rows that repeat id and text are one document here
    names = ["id", "th", "a", "lo", "n", "d", "k", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, t, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode("utf-8", "replace")
                for r in found:
                    row = [i, t, r["a"], r["lo"], r["n"], r["d"], r["k"], raw[r["lo"] : r["lo"] + r["n"] + length - 1]]
                    for c, x in zip(cols, row):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return joined.select("id", "th", "text", "runs").mapInArrow(run, "id long, th long, a long, lo long, n int, d int, k long, bytes binary")


def _sorted_groups(fetched: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the runs of each anchor, whole anchors per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            a = t.column("a").to_numpy()
            group = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]).astype(np.int64)]))
            texts = [x.as_py() for x in t.column("bytes")]
            got = repeated_windows(texts, group, t.column("d").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.int64), length)
            r = np.array([x[0] for x in got], np.int64)
            lo = t.column("lo").to_numpy()[r] + np.array([x[1] for x in got], np.int64)
            hi = lo + np.array([x[2] for x in got], np.int64) + length - 1
            cols = [t.column("id").combine_chunks().take(pa.array(r)), t.column("th").combine_chunks().take(pa.array(r)), pa.array(lo), pa.array(hi)]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=_FOUND_ARROW)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE:
                t = pa.Table.from_batches(held)
                a = t.column("a").to_numpy()
                cut = int(np.searchsorted(a, a[-1], "left"))  # the last anchor may go on
                if cut:
                    yield solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held) if cut else 0
        if held:
            yield solve(pa.Table.from_batches(held))

    kept = fetched.select("id", "th", "a", "lo", "n", "d", "bytes")
    shards = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(shards, "a").sortWithinPartitions("a", "id", "th", "lo").mapInArrow(run, _FOUND)


def _counted_windows(fetched: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the runs of crowded anchors, by the hash of each window
    (128 bits) and its distance."""
    kinds = [pa.int64()] * 5 + [pa.int32()]
    names = ["id", "th", "lo", "h1", "h2", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, a, lo, n, d, raw in zip(*(batch.column(k).to_pylist() for k in range(7))):
                h = [xxhash.xxh3_128_intdigest(raw[k : k + length]) for k in range(n)]
                h1 = np.array([x & (2**64 - 1) for x in h], np.uint64).view(np.int64)
                h2 = np.array([x >> 64 for x in h], np.uint64).view(np.int64)
                cols = [[i] * n, [t] * n, np.arange(lo, lo + n), h1, h2, np.arange(d, d - n, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    rows = fetched.select("id", "th", "a", "lo", "n", "d", "bytes").mapInArrow(run, "id long, th long, lo long, h1 long, h2 long, d int")
    rows = written(rows)
    twice = rows.groupBy("h1", "h2", "d").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return rows.join(twice, ["h1", "h2", "d"], "left_semi").select("id", "th", "lo", (F.col("lo") + length).alias("hi"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``id, th, spans``: per document (named by id and hash of its text) the byte spans
    ``lo, hi`` of repeated windows, not merged; documents without any are left out."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    every = written(runs(docs, length))
    again = every.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a")
    open_ = written(every.join(again, "a", "left_semi"))
    kinds = open_.groupBy("a", "u", "n", "d").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "lo")).alias("one"))
    kinds = written(kinds)
    copied = open_.join(kinds.where("copies > 1").select("a", "u", "n", "d"), ["a", "u", "n", "d"], "left_semi")
    whole = copied.select("id", "th", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    # anchors with several texts, one of them at least not yet answered
    mixed = kinds.groupBy("a").agg(F.count("*").alias("k"), F.min("copies").alias("least")).where("k > 1 AND least = 1").select("a", "k")
    wanted = kinds.join(mixed, "a").select("one.*", "a", "n", "d", "k")
    fetched = written(_fetched(docs, wanted, length))
    sorted_ = _sorted_groups(fetched.where(F.col("k") <= group_runs), length)
    counted = _counted_windows(fetched.where(F.col("k") > group_runs), length)
    spans = whole.unionAll(sorted_).unionAll(counted)
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``df``: ``id_col, n_bytes, n_removed, n_spans, kept`` (binary,
    the bytes left) and ``kept_sha256``.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in
    the same document or another, judged on the input. Null and empty texts have no
    bytes; texts shorter than ``length`` stay; rows that repeat id and text are copies
    of each other and lose all from ``length`` bytes on. An empty table gives an empty
    result.
    """
    found = repeated_spans(df, id_col, text_col, length)
    found = found.select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "spans")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    joined = docs.join(found.hint("shuffle_hash"), docs["id"].eqNullSafe(found["f_id"]) & (docs["th"] == found["f_th"]), "left")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8", "replace")
                cut = merged([(s["lo"], s["hi"]) for s in spans or ()])
                left, at = [], 0
                for lo, hi in cut:
                    left.append(raw[at:lo])
                    at = hi
                kept = b"".join([*left, raw[at:]])
                row = [i, len(raw), len(raw) - len(kept), len(cut), kept, hashlib.sha256(kept).hexdigest()]
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return joined.select("id", "text", "spans").mapInArrow(run, schema)
