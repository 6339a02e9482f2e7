"""Values at given ranks, exact, without ordering the data.

A pass over the source turns every series of numbers into cells: a cell says how much
(rows, weights) lies between two values that occur. The first pass makes many cells of
about equal content. From them follows a bracket for each wanted rank; the next pass
divides the brackets finely and gives one cell for everything between two of them, until
brackets hold single values. Every pass narrows the brackets by a factor of thousands,
so two passes are enough for millions of rows, and four for a thousand billion.

Tasks send cells, whose number is fixed; they are merged by series, so what is shuffled
and what the driver gets does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: cells of a pass, over all series and brackets of a task
CELLS = 1 << 14
#: cells of a bracket at least, so that every pass makes progress
LEAST_CELLS = 16
#: rows of a task, times series, whose cells are held before they are made fewer
ROWS_AT_ONCE = 1 << 20
#: parts in which the cells of one series are merged
SLOTS = 16
PASSES = 16

Series = Callable[[dict[str, np.ndarray]], list[tuple[np.ndarray, list[np.ndarray]]]]


@dataclass
class Cells:
    """Cells in order of ``hi``. ``region`` counts gaps (even) and brackets (odd);
    ``sums`` has one row per sum, the first is the one that ranks."""

    region: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, sums: Sequence[np.ndarray], edges: np.ndarray) -> "Cells":
        """Single values inside the brackets, one cell for each gap. ``edges`` are the
        ends of the brackets, in pairs; a missing number counts as infinity."""
        x = np.where(np.isnan(x), np.inf, x)
        after = np.searchsorted(edges[:, 1], x, "left")
        inside = x >= np.append(edges[:, 0], np.inf)[after]
        inside &= after < len(edges)
        region = 2 * after + inside
        table = np.array(sums, np.float64).reshape(len(sums), len(x))
        if inside.all():
            order = np.argsort(x)
        else:
            order = np.argsort(region if len(edges) > 10_000 else region.astype(np.int16), kind="stable")
            # brackets follow each other, so their values can be sorted together
            within = np.flatnonzero(inside[order])
            picked = order[within]
            order[within] = picked[np.argsort(x[picked])]
        c = cls(region[order], x[order], x[order], table[:, order])
        new = (np.diff(c.region) != 0) | ((c.region[1:] % 2 == 1) & (np.diff(c.hi) != 0)) if len(x) else np.empty(0, bool)
        return c._combined(np.flatnonzero(np.concatenate([[True], new]))) if len(x) else c

    @classmethod
    def joined(cls, parts: Sequence["Cells"]) -> "Cells":
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("region", "lo", "hi")], np.concatenate([p.sums for p in parts], axis=1))

    def _combined(self, heads: np.ndarray) -> "Cells":
        return Cells(self.region[heads], np.minimum.reduceat(self.lo, heads), np.maximum.reduceat(self.hi, heads), np.add.reduceat(self.sums, heads, axis=1))

    def compressed(self, quota: int) -> "Cells":
        """At most ``quota`` cells per bracket, of about equal content, and one per gap."""
        if not len(self.lo):
            return self
        # everything in a gap is one cell, so its order does not matter
        gap = self.region % 2 == 0
        order = np.lexsort((np.where(gap, 0, self.lo), np.where(gap, 0, self.hi), self.region))
        c = Cells(self.region[order], self.lo[order], self.hi[order], self.sums[:, order])
        single = c.lo == c.hi
        same = (np.diff(c.region) == 0) & ((c.region[1:] % 2 == 0) | (single[1:] & single[:-1] & (np.diff(c.hi) == 0)))
        c = c._combined(np.flatnonzero(np.concatenate([[True], ~same])))
        start = np.flatnonzero(np.concatenate([[True], np.diff(c.region) != 0]))
        if np.diff(np.append(start, len(c.lo))).max() <= quota:
            return c
        group = np.zeros(len(c.lo), np.int64)
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(c.lo)]):
            if b - a > quota:
                w = c.sums[0, a:b]
                if not w.sum() > 0:
                    w = np.ones(b - a)
                middle = np.cumsum(w) - w / 2
                group[a:b] = np.minimum(middle / w.sum() * quota, quota - 1).astype(np.int64)
            else:
                group[a:b] = np.arange(b - a)
        return c._combined(np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(c.region) != 0)])))

    def ordered(self) -> "Cells":
        order = np.lexsort((self.lo, self.hi))
        return Cells(self.region[order], self.lo[order], self.hi[order], self.sums[:, order])

    def packed(self) -> bytes:
        return np.concatenate([[len(self.sums)], self.region, self.lo, self.hi, self.sums.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> "Cells":
        x = np.frombuffer(data, "<f8")
        k = int(x[0])
        x = x[1:].reshape(3 + k, -1)
        return cls(x[0].astype(np.int64), x[1], x[2], x[3:])

    @property
    def total(self) -> float:
        return float(self.sums[0].sum())

    def brackets(self, targets: np.ndarray) -> np.ndarray:
        """For every target the first and the last value that may be the smallest whose
        cumulated content reaches it."""
        by_lo = np.argsort(self.lo, kind="stable")
        most, least = np.cumsum(self.sums[0][by_lo]), np.cumsum(self.sums[0])
        slack = 1e-12 * max(abs(self.total), 1e-300)
        last = len(self.lo) - 1
        first = self.lo[by_lo][np.minimum(np.searchsorted(most, targets - slack, "left"), last)]
        return np.stack([first, np.maximum(first, self.hi[np.minimum(np.searchsorted(least, targets + slack, "left"), last)])], axis=1)

    def settled(self, brackets: np.ndarray) -> bool:
        """Whether no cell of several values reaches into a bracket."""
        wide = self.lo < self.hi
        lo, hi = np.sort(self.lo[wide]), np.sort(self.hi[wide])
        return bool((np.searchsorted(lo, brackets[:, 1], "right") == np.searchsorted(hi, brackets[:, 0], "left")).all())

    def reaching(self, targets: np.ndarray) -> np.ndarray:
        """The smallest values whose cumulated content reaches the targets, once the
        cells are settled there. Sums are made in one order here."""
        return self.hi[np.minimum(np.searchsorted(np.cumsum(self.sums[0]), targets, "left"), len(self.hi) - 1)]


def _joined_brackets(pairs: np.ndarray) -> np.ndarray:
    """Overlapping brackets made one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    far = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > far[:-1]]))
    return np.stack([pairs[new, 0], np.append(far[new[1:] - 1], far[-1])], axis=1)


def _pass(df: DataFrame, series: Series, edges: list[np.ndarray], cells: int) -> list[Cells]:
    """Cells of every series for the given brackets."""
    quota = [max(LEAST_CELLS, cells // max(1, len(edges)) // max(1, len(e))) for e in edges]
    names = df.columns

    def shrink(held: list[list[Cells]]) -> None:
        for k, parts in enumerate(held):
            if parts:
                held[k] = [Cells.joined(parts).compressed(quota[k])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[list[Cells]] = [[] for _ in edges]
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(names, batch.columns)}
            for k, (x, sums) in enumerate(series(columns)):
                held[k].append(Cells.of(x, sums, edges[k]))
            rows += batch.num_rows * len(edges)
            if rows >= ROWS_AT_ONCE:
                shrink(held)
                rows = 0
        shrink(held)
        slot = TaskContext.get().partitionId() % SLOTS
        have = [(k, parts[0].packed()) for k, parts in enumerate(held) if parts]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in have], pa.int32()), pa.array([slot] * len(have), pa.int32()), pa.array([d for _, d in have], pa.binary())], names=["series", "slot", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Cells] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = Cells.unpacked(data)
                held[k] = Cells.joined([held[k], part]).compressed(quota[k]) if k in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([c.packed() for c in held.values()], pa.binary())], names=["series", "cells"])

    sent = df.mapInArrow(read, "series int, slot int, cells binary")
    merged = sent.repartition(min(SLOTS * len(edges), 256), "series", "slot").select("series", "cells").mapInArrow(merge, "series int, cells binary")
    parts: list[list[Cells]] = [[] for _ in edges]
    for row in merged.collect():
        parts[row["series"]].append(Cells.unpacked(bytes(row["cells"])))
    empty = Cells(np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty((1, 0)))
    return [Cells.joined(p).compressed(q).ordered() if p else empty for p, q in zip(parts, quota)]


def settled_cells(df: DataFrame, series: Series, count: int, targets: Callable[[int, Cells], Sequence[float]], cells: int = CELLS) -> list[Cells]:
    """Cells of ``count`` series that are single values wherever a target is reached.

    ``df`` has the columns that ``series`` needs (numbers); from the columns of a batch
    it makes, for every series, the values and the lists of their sums. ``targets`` gets
    the number and cells of a series after the first pass and gives the cumulated
    contents that are asked for. Runs one Spark job per pass.
    """
    whole = np.array([[-np.inf, np.inf]])
    found = _pass(df, series, [whole] * count, cells)
    wanted = [np.asarray(targets(k, c) if len(c.lo) else [], np.float64) for k, c in enumerate(found)]
    for _ in range(PASSES):
        brackets = [c.brackets(t) if len(t) else np.empty((0, 2)) for c, t in zip(found, wanted)]
        if all(c.settled(b) for c, b in zip(found, brackets)):
            return found
        found = _pass(df, series, [_joined_brackets(b) if len(b) else b for b in brackets], cells)
    raise RuntimeError("ranks did not settle")


def numbers(df: DataFrame, **columns) -> DataFrame:
    """Columns as doubles, rows without one of them left out."""
    out = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    return out.dropna() if out.columns else out


def kth_smallest(df: DataFrame, value: str, ranks: Callable[[int], Sequence[int]]) -> tuple[list[float], float, float, int]:
    """The values at ranks (from 1) that follow from the number of rows, the smallest
    and the largest value, and the number of rows. Missing values do not count."""
    rows = numbers(df, x=F.col(value))
    one = lambda c: [(c["x"], [np.ones(len(c["x"]))])]
    kept: list[Sequence[int]] = []

    def targets(_: int, cells: Cells) -> Sequence[float]:
        kept.append(ranks(round(cells.total)))
        return [float(k) for k in kept[0]]

    cells = settled_cells(rows, one, 1, targets)[0]
    if not len(cells.lo):
        raise ValueError(f"no data in {value}")
    n = round(cells.total)
    if any(not 1 <= k <= n for k in kept[0]):
        raise ValueError(f"{value} has fewer values than asked for")
    return cells.reaching(np.array(kept[0], np.float64)).tolist() if len(kept[0]) else [], float(cells.lo.min()), float(cells.hi.max()), n
