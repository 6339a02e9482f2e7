"""Jobs that put the operators together: skim, collect, sampling."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators.scale import ordered_rank
from eventloom.operators.steps import StepList, apply_steps, apply_variant
from eventloom.operators.variations import weight_product


class JobType(Enum):
    """What a channel is; the value names its weight."""

    MC = "MCTotalWeight"
    DATA_DRIVEN = "DDTotalWeight"
    DATA = "one"

    @classmethod
    def of(cls, is_data, is_dd=False) -> "JobType":
        """From flags that are 0/1, booleans or channel maps with equal values."""
        flat = lambda x: any(bool(v) for v in x.values()) if isinstance(x, dict) else bool(x)
        if flat(is_data) and flat(is_dd):
            raise ValueError("a job is either data or data-driven")
        return cls.DATA if flat(is_data) else cls.DATA_DRIVEN if flat(is_dd) else cls.MC

    def weight(self, mc: Sequence[str], dd: Sequence[str]) -> Column:
        return F.lit(1.0) if self is JobType.DATA else weight_product(mc if self is JobType.MC else dd)


def first_fraction(df: DataFrame, fraction: float, key: Sequence[str]) -> DataFrame:
    """The first ``max(1, int(N * fraction))`` rows in key order, the sampling
    operator of the trigger study. The number of rows grows with the table, so
    rows are ranked range by range instead of being taken into one task."""
    n = df.count()
    return ordered_rank(df, "_rank", key).filter(F.col("_rank") <= max(1, int(n * fraction))).drop("_rank")


@dataclass
class SkimJob:
    """Selection of events: steps, columns to keep, optional ledger column.

    With an envelope (simulation only) the steps named in ``replaced`` are left out:
    their nominal cuts would drop events that pass under a variation only, and the
    envelope stands for them. ``after`` are steps on the kept events.
    """

    steps: StepList
    columns: Sequence[str]
    is_data: bool = False
    data_filter: object = None  # DataFrame -> DataFrame, e.g. run ranges
    envelope: object = None  # DataFrame -> DataFrame, simulation only
    replaced: Collection[str] = ()
    after: StepList = field(default_factory=StepList)
    extra: dict = field(default_factory=dict)

    def rows(self, events: DataFrame) -> DataFrame:
        if self.is_data and self.data_filter is not None:
            events = self.data_filter(events)
        steps = self.steps
        if not self.is_data and self.envelope is not None:
            events = self.envelope(events)
            steps = steps.without(self.replaced)
        out = apply_steps(events, steps + self.after)
        return out.select(*[c for c in self.columns if c in out.columns])


def collect_job(
    events: DataFrame,
    steps: StepList,
    axes: Sequence[Axis],
    weight: Column,
    keys: Sequence[str],
    shifts: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """All variables, nominal and shifted, of all channels in one scan.

    Definitions are hoisted before the cuts. Every shift (suffix -> replaced
    columns) runs as a variant with flags; each row then contributes one entry
    per variation it passes.
    """
    steps = steps.hoisted()
    names = {"": "_pass"} | {s: f"_pass{s}" for s in (shifts or {})}
    df = events.withColumn("_w", weight)
    kept = df
    for suffix, shifted in (shifts or {}).items():
        kept = apply_variant(kept, steps, suffix, shifted, flags=True, final_flag=f"_pass{suffix}")
    kept = apply_variant(kept, steps, "__nominal", {}, flags=True, final_flag="_pass")
    entries = []
    for suffix, flag in names.items():
        for a in axes:
            made = [f"{a.var}{suffix or '__nominal'}", a.var]
            col = next((c for c in made if c in kept.columns), None)
            entries.append(
                F.when(
                    F.col(flag),
                    F.struct(
                        F.lit(suffix.lstrip("_") or "nominal").alias("variation"), F.lit(a.var).alias("var"), a.index(F.col(col)).alias("ix")
                    ),
                )
            )
    rows = kept.select(*keys, "_w", F.explode(F.array(*entries)).alias("_e")).filter(F.col("_e").isNotNull()).select(*keys, "_w", "_e.*")
    rows = rows.dropna(subset=["ix"])
    return rows.groupBy(*keys, "variation", "var", "ix").agg(
        F.sum("_w").alias("sumw"), F.sum(F.col("_w") * F.col("_w")).alias("sumw2"), F.count(F.lit(1)).alias("n")
    )
