"""Stretches of words that repeat with a period, found while the words arrive.

Words are appended in order. For every power of two ``L``, each completed block of
``L`` words (at multiples of ``L``) has a catcher: it compares the ``L`` words that end
at every appended word, two to four block lengths on, with its own, by hash. A square
of half-length ``q`` in ``[2L, 4L)`` holds a whole block in its first half, so some
catcher meets it (half-lengths 1 to 3 belong to blocks of one word). An equal suffix is
extended to both sides on the words themselves; while it reaches the last word it stays
open and goes on with the next words. Where the equal stretch is as long as its
distance, its squares are one run; runs of equal extent are one run of the smallest
period.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words appended at a time
SLICE = 1 << 14
#: candidates of a level from which regions of smaller period are taken out first
MANY = 64
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C[0]
    return x ^ (x >> np.uint64(29))


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal items at the beginning of two arrays of one length."""
    at, step = 0, 32
    while at < len(a):
        odd = a[at : at + step] != b[at : at + step]
        k = int(odd.argmax())
        if odd[k]:
            return at + k
        at, step = at + step, step * 4
    return len(a)


class SquareCatcher:
    """Runs of the words appended so far. ``append`` takes integer word ids."""

    def __init__(self) -> None:
        self.n, self.words = 0, np.empty(256, np.int64)
        #: for each level the first position kept, and the hashes from there on
        self.levels: list[tuple[int, np.ndarray]] = []
        #: (period, start) -> end: word x equals word x + period for start <= x < end,
        #: and the last word appended is still one of them
        self.open: dict[tuple[int, int], int] = {}
        #: (start, end) -> smallest period known, of runs that have ended
        self.ended: dict[tuple[int, int], int] = {}

    def append(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        old, self.n = self.n, self.n + len(ids)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.empty(2 * self.n - old, np.int64)])
        self.words[old : self.n] = ids
        moved = self._advance()
        recent = [(s, e + q, q) for q, s, e in moved if e - s >= q]
        with np.errstate(over="ignore"):
            level = 0
            while level < len(self.levels) or (3 if level else 1) << level <= self.n:
                at, size, q = self._caught(level)
                if len(at):
                    self._settle(level, at, size, q, moved, recent)
                level += 1
        # catchers of ended blocks out of reach are let go
        for k, (first, h) in enumerate(self.levels):
            keep = max(first, self.n - (8 << k))
            self.levels[k] = (keep, h[keep - first :])

    def _advance(self) -> list[tuple[int, int, int]]:
        """Open stretches go on over the new words; returns all of them."""
        w, moved, still = self.words[: self.n], [], {}
        for (q, s), e in self.open.items():
            e += _first_difference(w[e : self.n - q], w[e + q : self.n])
            moved.append((q, s, e))
            if e + q == self.n:
                still[q, s] = e
            else:
                self._report(q, s, e)
        self.open = still
        return moved

    def _report(self, q: int, s: int, e: int) -> None:
        if e - s >= q:
            self.ended[s, e + q] = min(q, self.ended.get((s, e + q), q))

    def _hashes(self, level: int) -> tuple[int, np.ndarray, int]:
        """Hashes of the words from each position on: the first position kept, the
        hashes, and the first position that is new."""
        width = 1 << level
        if level == len(self.levels):
            first, kept, new = 0, np.empty(0, np.uint64), 0
        else:
            first, kept = self.levels[level]
            new = first + len(kept)
        if level == 0:
            fresh = _mixed(self.words[new : self.n].astype(np.uint64) + _C[2])
        else:
            below, h = self.levels[level - 1]
            half = width >> 1
            left = h[new - below : self.n - width + 1 - below]
            fresh = _mixed(left * _C[1] + h[new + half - below : new + half - below + len(left)])
        return first, np.concatenate([kept, fresh]), new

    def _caught(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of neighbouring blocks whose words recur at one distance: first word,
        words, distance."""
        width = 1 << level
        first, h, new = self._hashes(level)
        p = np.arange(new, first + len(h))
        block = p >> level << level
        starts, gaps = [], []
        for back in (2, 3) if level else (1, 2, 3):
            i = block - (back << level)
            ok = int(np.searchsorted(i, 0))
            hit = np.flatnonzero(h[i[ok:] - first] == h[new - first + ok :]) + ok
            starts.append(i[hit])
            gaps.append(p[hit] - i[hit])
        if level == len(self.levels):
            self.levels.append((first, h))
        else:
            self.levels[level] = (first, h)
        i, q = np.concatenate(starts), np.concatenate(gaps)
        if not len(i):
            return i, i, q
        if level:
            order = np.lexsort((i, q))
            i, q = i[order], q[order]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(i) != width)]))
        return i[head], np.diff(np.append(head, len(i))) << level, q[head]

    def _settle(self, level: int, at: np.ndarray, size: np.ndarray, q: np.ndarray, moved: list, recent: list) -> None:
        """Extend what was caught; ``moved`` are the stretches known from the words
        before, ``recent`` the runs that reach into the new words."""
        width, n = 1 << level, self.n
        # neither neighbour block is equal, so an ended stretch is shorter than this
        could = (size + 2 * (width - 1) >= q) | (at + size + q + width > n)
        for mq, s, e in moved:
            could &= (q != mq) | (at < s) | (at >= e)
        if level and len(at) > MANY and recent:
            # multiples of a smaller period inside its run are no new squares
            known = np.array(sorted(recent), np.int64)
            far = np.maximum.accumulate(known[:, 1])
            which = np.maximum.accumulate(np.where(np.diff(far, prepend=-1) > 0, np.arange(len(far)), 0))
            k = np.searchsorted(known[:, 0], at, "right") - 1
            inside = (k >= 0) & (far[k] >= at + size + q) & (q % known[which[k], 2] == 0)
            could &= ~inside
        w = self.words
        for s, length, d in zip(at[could].tolist(), size[could].tolist(), q[could].tolist()):
            e = s + length
            if level:
                if not np.array_equal(w[s:e], w[s + d : e + d]):
                    continue
                s -= _first_difference(w[:s][::-1], w[d : s + d][::-1])
                e += _first_difference(w[e : n - d], w[e + d : n])
            if e + d == n:
                self.open[d, s] = e
            else:
                self._report(d, s, e)
            if e - s >= d:
                recent.append((s, e + d, d))

    def runs(self, least_words: int = 2, least_times: int = 2) -> list[tuple[int, int, int]]:
        """``start, length, period`` of the runs of the words so far that have at least
        ``least_words`` words and ``least_times`` (2 or more) periods."""
        found = dict(self.ended)
        for (q, s), e in self.open.items():
            if e - s >= q:
                found[s, e + q] = min(q, found.get((s, e + q), q))
        return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least_words, least_times * q))


def runs_of(words: list, least_words: int = 2, least_times: int = 2) -> list[tuple[int, int, int]]:
    """Runs of a list of words."""
    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))
    catcher = SquareCatcher()
    for at in range(0, len(ids), SLICE):
        catcher.append(ids[at : at + SLICE])
    return catcher.runs(least_words, least_times)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


_RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_times: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, ``_x_runs`` (array of ``start, length, period``
    in words, by start, then period) and ``_x_text``, the words that remain, one space
    between them, when of each run only the first period is kept.

    Words end at ASCII white space. A run is a stretch of at least ``least_words`` words
    and ``least_times`` smallest periods that cannot be made longer with its period;
    overlapping runs are all reported. Null, empty and blank texts have no runs and an
    empty text; ids may be null or repeated, each row is read by itself; other columns
    are not carried. Work and memory follow the longest text, n log n words at worst in
    its length; nothing is shuffled.
    """
    if least_times < 2:
        raise ValueError("a run has two periods at least")
    kind = df.schema[id_col].dataType
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches):
        for batch in batches:
            out, left = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                runs = runs_of(words, least_words, least_times)
                out.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                left.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(run)), pa.array(left, pa.binary()).cast(pa.string())], names=["_x_id", "_x_runs", "_x_text"])

    slim = df.select(F.col(id_col).alias("_x_id"), F.col(text_col).cast("string").alias("_x_words"))
    return slim.mapInArrow(search, f"_x_id {kind.simpleString()}, _x_runs array<{_RUN}>, _x_text string").withColumnRenamed("_x_id", id_col)


def with_loops(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col`` where the text of about every tenth id has been made to
    repeat a part of itself to its end, by a digest of the id: input with runs of known
    kind. With h the CRC-32 of the decimal id, g = h div 10 and n words, texts with
    h % 10 = 0 get word a + (i - a) % p for every word i from a = g % n on, where
    p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without an id stay as
    they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def looped(ws):
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8))
        order = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n == 0, F.lit("")).otherwise(
            F.concat_ws(" ", F.transform(order, lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))
        )

    # one-element arrays bind the words once
    text = F.when(h % 10 == 0, F.transform(F.array(words), looped)[0]).otherwise(F.col(text_col))
    return df.select(id_col, text.alias(text_col))
