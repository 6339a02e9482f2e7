"""Step lists: ordered definitions and cuts applied to an event table.

A step is ``(operation, name, expression)``. Expressions are Spark SQL, so
Catalyst prunes, pushes down and compiles them. Variants of a list (systematic
shifts) are evaluated in the same scan: the list runs on a projection in which
the shifted columns carry the nominal names, so no expression is rewritten.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.kinematics import folded_delta_r, p4_from_energy, p4_from_mass

P4_OPERATIONS = ("TLVPtEtaPhiM", "TLVPtEtaPhiM_corr", "TLVPtEtaPhiE")
DEFINITIONS = ("define", "redefine", "defineDR", *P4_OPERATIONS)
OPERATIONS = ("cut", *DEFINITIONS)


@dataclass(frozen=True)
class Step:
    op: str
    name: str
    expr: str

    def __post_init__(self) -> None:
        if self.op not in OPERATIONS:
            raise ValueError(f"unknown step operation {self.op!r}")
        if self.op in P4_OPERATIONS or self.op == "defineDR":
            if len(self.arguments) != 4 or not all(self.arguments):
                raise ValueError(f"{self.op} {self.name}: needs exactly four comma-separated columns")

    @property
    def arguments(self) -> list[str]:
        return [a.strip() for a in self.expr.split(",")]

    @property
    def defines(self) -> bool:
        return self.op in DEFINITIONS

    def column(self) -> Column:
        if self.op in ("TLVPtEtaPhiM", "TLVPtEtaPhiM_corr"):
            return p4_from_mass(*[F.col(a).cast("double") for a in self.arguments])
        if self.op == "TLVPtEtaPhiE":
            return p4_from_energy(*[F.col(a).cast("double") for a in self.arguments])
        if self.op == "defineDR":
            eta1, eta2, phi1, phi2 = [F.col(a) for a in self.arguments]
            return folded_delta_r(eta1, phi1, eta2, phi2, pi=3.1416, full=6.2832)
        return F.expr(self.expr)


class StepList:
    """Immutable ordered list of steps."""

    def __init__(self, steps: Iterable[Step | Sequence[str]] = ()):
        self.steps = tuple(s if isinstance(s, Step) else Step(*s) for s in steps)

    def __add__(self, other: "StepList") -> "StepList":
        return StepList(self.steps + other.steps)

    def __iter__(self):
        return iter(self.steps)

    def __len__(self) -> int:
        return len(self.steps)

    def appended(self, op: str, name: str, expr: str) -> "StepList":
        return StepList((*self.steps, Step(op, name, expr)))

    def without(self, names: Collection[str]) -> "StepList":
        return StepList(s for s in self.steps if s.name not in names)

    def definitions(self, wanted: Callable[[str], bool] = lambda _: True) -> "StepList":
        return StepList(s for s in self.steps if s.defines and wanted(s.name))

    def hoisted(self) -> "StepList":
        """All definitions first, then the cuts whose label is not a defined
        name. A later redefinition therefore also acts on earlier cuts."""
        defs = [s for s in self.steps if s.defines]
        names = {s.name for s in defs}
        return StepList([*defs, *(s for s in self.steps if s.op == "cut" and s.name not in names)])


def apply_steps(df: DataFrame, steps: StepList, strict: bool = True) -> DataFrame:
    """Run the steps in order. Definitions that do not use each other go into
    one projection; ``strict`` makes ``redefine`` of a missing column an error."""
    pending: dict[str, Column] = {}

    def flush(frame: DataFrame) -> DataFrame:
        nonlocal pending
        out = frame.withColumns(pending) if pending else frame
        pending = {}
        return out

    known = set(df.columns)
    for step in steps:
        words = set(re.findall(r"\w+", step.expr))
        if pending and (step.op == "cut" or step.name in pending or words & set(pending)):
            df = flush(df)
        if step.op == "cut":
            df = df.filter(F.expr(step.expr))
            continue
        if strict and step.op == "redefine" and step.name not in known:
            raise ValueError(f"redefine of unknown column {step.name}")
        known.add(step.name)
        pending[step.name] = step.column()
    return flush(df)


def pass_flag_name(label: str, suffix: str) -> str:
    return "pass_" + re.sub(r"\W", "_", label) + suffix


def apply_variant(
    df: DataFrame,
    steps: StepList,
    suffix: str,
    shifted: dict[str, str],
    cuts: Collection[str] = (),
    flags: bool = False,
    final_flag: str | None = None,
) -> DataFrame:
    """Evaluate the list a second time with some columns replaced.

    ``shifted`` maps a nominal column to the one that stands in for it. Every
    defined name comes back with ``suffix``; everything else keeps its value.
    Either the cuts named in ``cuts`` filter rows, or (``flags``) every cut
    becomes a cumulative flag ``pass_<label><suffix>`` plus one final flag, and
    no row is dropped, so any number of variants shares one scan.
    """
    defined = list(dict.fromkeys(s.name for s in steps if s.defines))
    touched = [c for c in dict.fromkeys([*shifted, *defined]) if c in df.columns]
    work = df.withColumns({f"_kept_{c}": F.col(c) for c in touched})
    work = work.withColumns({name: F.col(f"_kept_{src}" if src in touched else src) for name, src in shifted.items()})

    made: list[str] = []
    last: str | None = None
    run: list[Step] = []
    for step in steps:
        if step.defines:
            run.append(step)
        elif flags:
            flag = pass_flag_name(step.name, suffix)
            work = apply_steps(work, StepList(run), strict=False)
            run = []
            now = F.coalesce(F.expr(step.expr), F.lit(False))
            work = work.withColumn(flag, now if last is None else F.col(last) & now)
            made.append(flag)
            last = flag
        elif step.name in cuts:
            run.append(step)
    work = apply_steps(work, StepList(run), strict=False)
    if flags:
        final = final_flag or f"pass_all{suffix}"
        work = work.withColumn(final, F.lit(True) if last is None else F.col(last))
        made.append(final)

    back = [F.col(f"_kept_{c}").alias(c) if c in touched else F.col(c) for c in df.columns]
    fresh = [F.col(n).alias(n + suffix) for n in defined]
    return work.select(*back, *fresh, *[F.col(m) for m in dict.fromkeys(made)])


def variant_name(name: str, steps: StepList, suffix: str, shifted: dict[str, str]) -> str:
    """Column that carries ``name`` in a variant."""
    if any(s.defines and s.name == name for s in steps):
        return name + suffix
    return shifted.get(name, name)


# --- helpers around optional columns ---------------------------------------------


def first_available(df: DataFrame, alias: str, candidates: Sequence[str]) -> DataFrame:
    """Add ``alias`` as the first of several optional columns."""
    for name in candidates:
        if name in df.columns:
            return df.withColumn(alias, F.col(name))
    raise ValueError(f"{alias}: none of {', '.join(candidates)} is available")


def column_or_expr(df: DataFrame, spec: str) -> Column:
    """A spec is the name of an existing column or an expression."""
    return F.col(spec) if spec in df.columns else F.expr(spec)


def any_positive(df: DataFrame, prefix: str) -> Column:
    """True when any column whose name starts with ``prefix`` is positive."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError(f"no column starts with {prefix}")
    flags = [F.coalesce(F.col(n) > 0, F.lit(False)) for n in names]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def piecewise(x: Column, parts: Sequence[tuple[float | None, float | None, float]], default: float = 0.0) -> Column:
    """Piecewise-constant function over half-open intervals (None = open end)."""
    out = None
    for lo, hi, value in parts:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (x >= lo)
        if hi is not None:
            cond = cond & (x < hi)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def envelope_filter(
    df: DataFrame,
    coll: str,
    pt: str,
    sources: Sequence[str],
    accept: Callable[[Column], Column],
    min_count: int,
    threshold: float,
    resolution: tuple[str, str, str] | None = None,
    weight_prefix: str | None = None,
) -> DataFrame:
    """Safe pre-selection for every variation at once.

    Objects carry ``pt``, the relative ``sources`` and, for the resolution part,
    the fields (uncorrected pt, up factor, down factor). Rows are kept when at
    least ``min_count`` accepted objects pass ``threshold`` with the largest
    upward value, so each single variation selects a subset of the result.
    """

    def highest(o: Column) -> Column:
        total = F.sqrt(sum((o[s] * o[s] for s in sources), F.lit(0.0)))
        if resolution is None:
            return o[pt] * (1.0 + total)
        raw, up, down = resolution
        jes = o[pt] * total
        rise = F.greatest(F.lit(0.0), F.greatest(o[raw] * o[up], o[raw] * o[down]) - o[pt])
        return o[pt] + F.sqrt(jes * jes + rise * rise)

    if not sources:
        raise ValueError("the envelope needs at least one source")
    keep = F.size(F.filter(F.col(coll), lambda o: (highest(o) > threshold) & accept(o))) >= min_count
    if weight_prefix is not None:
        keep = keep & any_positive(df, weight_prefix)
    return df.filter(keep)
