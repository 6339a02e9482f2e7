"""Names, values and validity of systematic variations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.scale import values_table


def weight_product(factors: Sequence[str], replace: dict[str, str] | None = None) -> Column:
    """Product of weight columns, some of them replaced for a variation."""
    swap = replace or {}
    return reduce(lambda a, b: a * b, [F.col(swap.get(f, f)).cast("double") for f in factors], F.lit(1.0))


def shifted_weight_name(weight: str, source: str, direction: str) -> str:
    """``<weight>_<source>_<direction>``; veto-map weights drop ``CMS_`` and tag
    weights drop ``btag_`` from the source."""
    if weight.startswith("JVM"):
        source = source.removeprefix("CMS_")
    if weight.startswith("btag"):
        source = source.removeprefix("btag_")
    return f"{weight}_{source}_{direction}" if source else f"{weight}_{direction}"


def shifted_field_name(field: str, source: str, direction: str) -> str:
    """``Jet_pt`` shifted by ``src`` up is ``Jet_src_up_pt``."""
    head, _, tail = field.partition("_")
    return f"{head}_{source}_{direction}_{tail}" if tail else f"{field}_{source}_{direction}"


def shifted_value(value: Column, direction: str, relative: Column | None = None, corr: Column | None = None, corr_shifted: Column | None = None) -> Column:
    """``x * (1 ± s)`` for a relative source, ``x / corr * corr_shifted`` for a
    multiplicative one; giving both is an error."""
    if (relative is None) == (corr is None):
        raise ValueError("give either a relative source or a correction pair")
    if relative is not None:
        sign = {"up": 1.0, "down": -1.0}[direction]
        return value * (1.0 + sign * relative)
    return value / corr * corr_shifted


@dataclass(frozen=True)
class Variation:
    """A source acting on weights or on columns."""

    source: str
    targets: tuple[str, ...]
    kind: str = "weight"  # weight | shift

    def needed(self) -> list[str]:
        if self.kind == "weight":
            return [shifted_weight_name(t, self.source, d) for t in self.targets for d in ("up", "down")]
        return [self.source, *self.targets]


def usable(spark: SparkSession, columns: Sequence[str], variations: Sequence[Variation]) -> tuple[list[Variation], DataFrame]:
    """Variations whose columns exist, and a report of all with the reason for
    each skipped one. A wrong configuration raises."""
    have = set(columns)
    names = [v.source for v in variations]
    if len(set(names)) != len(names):
        raise ValueError("a variation is listed twice")
    rows, good = [], []
    for v in variations:
        if not v.targets or v.kind not in ("weight", "shift"):
            raise ValueError(f"variation {v.source}: needs targets and a known kind")
        missing = [c for c in v.needed() if c not in have]
        if not missing:
            good.append(v)
        rows.append((v.source, not missing, "missing " + ", ".join(missing) if missing else ""))
    return good, values_table(spark, "variation string, used boolean, reason string", rows)


def quadrature_shift(nominal: Column, varied: Sequence[Column], up: bool) -> Column:
    """Nominal plus (minus) the root of the summed squared one-sided shifts;
    the lower value never goes below zero."""
    sign = 1.0 if up else -1.0
    square = F.lit(0.0)
    for v in varied:
        d = F.greatest(F.lit(0.0), (v - nominal) * sign)
        square = square + d * d
    return nominal + F.sqrt(square) if up else F.greatest(F.lit(0.0), nominal - F.sqrt(square))
