"""Axes: from a value to a bin number, and back to bin edges.

Bins 1..n are half-open [lo, hi); 0 collects values below, n+1 values at or
above the end and NaN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.vectors import double_array


@dataclass(frozen=True)
class Axis:
    """Either ``n`` equal bins in [lo, hi) or the given ``edges``."""

    var: str
    n: int = 0
    lo: float = 0.0
    hi: float = 0.0
    edges: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.edges:
            if len(self.edges) < 2 or not all(math.isfinite(e) for e in self.edges):
                raise ValueError(f"{self.var}: at least two finite edges are needed")
            if any(b <= a for a, b in zip(self.edges, self.edges[1:])):
                raise ValueError(f"{self.var}: edges must be strictly increasing")
            if self.n not in (0, len(self.edges) - 1):
                raise ValueError(f"{self.var}: number of bins does not fit the edges")
            object.__setattr__(self, "n", len(self.edges) - 1)
            object.__setattr__(self, "lo", float(self.edges[0]))
            object.__setattr__(self, "hi", float(self.edges[-1]))
        else:
            if self.n <= 0 or not (math.isfinite(self.lo) and math.isfinite(self.hi)) or self.hi <= self.lo:
                raise ValueError(f"{self.var}: needs a positive number of bins and min < max")

    @classmethod
    def from_config(cls, var: str, spec: dict) -> "Axis":
        """From ``{nBins, min, max}`` or ``{nBins?, binning: [...]}`` (numbers may be text)."""
        n = int(spec.get("nBins", 0))
        if spec.get("binning"):
            return cls(var, n, edges=tuple(float(e) for e in spec["binning"]))
        if "min" not in spec or "max" not in spec or n <= 0:
            raise ValueError(f"{var}: needs nBins with min and max, or binning")
        return cls(var, n, float(spec["min"]), float(spec["max"]))

    def all_edges(self) -> list[float]:
        if self.edges:
            return list(self.edges)
        width = (self.hi - self.lo) / self.n
        return [self.lo + i * width for i in range(self.n)] + [self.hi]

    def index(self, x: Column) -> Column:
        """Bin number of ``x`` (NULL for NULL)."""
        if self.edges:
            if len(self.edges) <= 64:
                bin_no = sum(((x >= F.lit(e)).cast("int") for e in self.edges), F.lit(0))
            else:
                bin_no = F.size(F.filter(double_array(self.edges), lambda e: e <= x))
            return F.when(x.isNotNull(), bin_no).cast("int")
        x = x.cast("double")
        return (
            F.when(x < self.lo, 0)
            .when(x >= self.hi, self.n + 1)
            .otherwise(F.width_bucket(x, F.lit(self.lo), F.lit(self.hi), F.lit(self.n)))
            .cast("int")
        )

    def clamped_index(self, x: Column) -> Column:
        """Bin number with flow values moved into the outer bins (so the upper
        end of the last bin is inside)."""
        return F.least(F.greatest(self.index(x), F.lit(1)), F.lit(self.n))

    def region(self, x: Column) -> Column:
        """0-based region of a coordinate, last edge inclusive, NULL outside."""
        inside = (x >= self.lo) & (x < self.hi)
        last = F.abs(x - self.hi) < 1e-9
        return F.when(inside, self.index(x) - 1).when(last, F.lit(self.n - 1)).cast("int")

    def low(self, ix: Column) -> Column:
        """Lower edge of a bin, NULL for the underflow bin."""
        if self.edges:
            return F.get(double_array(self.edges), ix - 1)
        width = (self.hi - self.lo) / self.n
        return F.when(ix >= 1, F.lit(self.lo) + (ix - 1) * F.lit(width))

    def high(self, ix: Column) -> Column:
        """Upper edge of a bin, NULL for the overflow bin."""
        if self.edges:
            return F.get(double_array(self.edges), ix)
        width = (self.hi - self.lo) / self.n
        return F.when(ix <= self.n, F.lit(self.lo) + ix * F.lit(width))

    def center(self, ix: Column) -> Column:
        return (self.low(ix) + self.high(ix)) / 2.0


def equal_width_position(x: Column, edges: list[float]) -> Column:
    """Where a coordinate lies when all bins are drawn equally wide: 0 at the
    first edge, 1 at the second, and so on."""
    out = F.when(x <= edges[0], F.lit(0.0)).when(x >= edges[-1], F.lit(float(len(edges) - 1)))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.when(x <= b, F.lit(float(i)) + (x - a) / (b - a))
    return out
