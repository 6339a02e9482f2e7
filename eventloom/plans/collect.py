"""The whole collect job: all variables of all channels under all variations.

A configuration becomes weights of the nominal selection (nominal and weight
variations) and shifts, each with its own values, selection and weight. Every event
contributes one entry per variable and set of weights that shares a selection; the
entries of all channels, variables and variations are summed by one aggregation, so
the events are read once and the shuffled rows are bounded by the number of bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from eventloom.functions.binning import Axis
from eventloom.operators.scale import values_table
from eventloom.operators.steps import StepList, apply_variant
from eventloom.operators.variations import shifted_field_name, shifted_value, shifted_weight_name, weight_product
from eventloom.plans.jobs import JobType

#: weights summed by one entry; further ones make further entries of the event
CHUNK = 8
DIRECTIONS = ("up", "down")


@dataclass(frozen=True)
class Variable:
    """One histogram: an axis, or two."""

    x: Axis
    y: Axis | None = None

    @property
    def name(self) -> str:
        return self.x.var if self.y is None else f"{self.x.var}_vs_{self.y.var}"


def variables(binnings: Mapping[str, Mapping], one: Sequence[str] = (), two: Sequence[Sequence[str]] = ()) -> list[Variable]:
    """Histograms from a binning configuration, names and pairs of names."""
    axis = lambda name: Axis.from_config(name, dict(binnings[name]))
    out = [Variable(axis(v)) for v in one]
    for pair in two:
        if len(pair) != 2:
            raise ValueError("a two-dimensional variable is a pair of names")
        out.append(Variable(axis(pair[0]), axis(pair[1])))
    if not out:
        raise ValueError("at least one variable is needed")
    return out


def collected_channels(datasets: Sequence[str], merged: Mapping[str, Sequence[str]] | None = None, selected: Sequence[str] = ()) -> list[tuple[str, str]]:
    """``(channel, group)`` in the order of the top level; a merged entry stands for
    its components, whose group is its name, others have an empty group."""
    unknown = sorted(set(selected) - set(datasets))
    if unknown:
        raise ValueError(f"not a top-level dataset: {', '.join(unknown)}")
    groups = merged or {}
    out = []
    for name in datasets:
        if selected and name not in selected:
            continue
        out += [(part, name) for part in groups[name]] if name in groups else [(name, "")]
    return out


def _expanded(config: Mapping[str, object], aliases: Mapping[str, Sequence[str]], what: str) -> dict[str, object]:
    out: dict[str, object] = {}
    for name, value in config.items():
        for member in aliases.get(name, [name]):
            if member in out:
                raise ValueError(f"{what} {member} is listed twice")
            out[member] = value
    return out


@dataclass(frozen=True)
class WeightSource:
    """A source that replaces one factor of the weight."""

    name: str
    factor: str

    def column(self, direction: str) -> str:
        return shifted_weight_name(self.factor, "" if self.factor == self.name else self.name, direction)


@dataclass(frozen=True)
class ShiftSource:
    """A source that replaces columns, or fields of collections (``jets.pt``), and
    perhaps one factor of the weight (``weights``: factor, up, down).

    The value becomes ``x * (1 ± source)``; with ``ratio`` it becomes
    ``x / ratio * ratio_up`` (or ``_down``). The source, or the ratios, are columns, or
    fields of the collection.
    """

    name: str
    targets: tuple[str, ...]
    ratio: str | None = None
    weights: tuple[str, str, str] | None = None

    def needed(self, direction: str) -> list[str]:
        own = [self.name] if self.ratio is None else [self.ratio, f"{self.ratio}_{direction}"]
        out = []
        for t in self.targets:
            inside = t.partition(".")[0] + "." if "." in t else ""
            out += [t, *(inside + x for x in own)]
        if self.weights:
            out += [self.weights[0], self.weights[1 + DIRECTIONS.index(direction)]]
        return list(dict.fromkeys(out))


@dataclass
class CollectJob:
    """What to collect. ``factors`` are the columns whose product is the weight (none:
    every event counts 1), ``weight`` its name in the result."""

    channels: list[tuple[str, str]]
    variables: list[Variable]
    steps: StepList
    factors: tuple[str, ...] = ()
    weight: str = "MCTotalWeight"
    weight_sources: list[WeightSource] = field(default_factory=list)
    shift_sources: list[ShiftSource] = field(default_factory=list)
    fold: bool = True

    @classmethod
    def from_config(cls, config: Mapping, steps: StepList, binnings: Mapping[str, Mapping], aliases: Mapping[str, Sequence[str]] | None = None, ratios: Mapping[str, str] | None = None, selected: Sequence[str] = ()) -> "CollectJob":
        """From a job configuration (``datasets``, ``needMerge``, ``isData``, ``isDD``,
        ``MCweight``, ``DDweight``, ``varNames``, ``varNames_2D``, ``weightSyst``,
        ``shiftSyst``, ``shiftWeightSyst``), the binnings of the variables, the aliases
        of sources and the sources that are ratios of corrections."""
        kind = JobType.of(config.get("isData", 0), config.get("isDD", 0))
        known = aliases or {}
        channels = collected_channels(config["datasets"], config.get("needMerge"), selected)
        wanted = variables(binnings, config.get("varNames", ()), config.get("varNames_2D", ()))
        if kind is JobType.DATA:
            return cls(channels, wanted, steps, (), kind.value)
        factors = tuple(config["DDweight" if kind is JobType.DATA_DRIVEN else "MCweight"])
        if not factors:
            raise ValueError("the list of weights is empty")
        weight_sources = [WeightSource(n, f) for n, f in _expanded(config.get("weightSyst", {}), known, "weight source").items()]
        own: dict[str, tuple[str, str, str]] = {}
        for name, given in config.get("shiftWeightSyst", {}).items():
            members = known.get(name, [name])
            if len(given) not in (1, 3) or (len(members) > 1 and len(given) != 1):
                raise ValueError(f"weights of shift {name}: [factor], or [factor, up, down] for a single source")
            if given[0] not in factors:
                raise ValueError(f"weights of shift {name}: {given[0]} is no factor of the weight")
            for member in members:
                if member in own:
                    raise ValueError(f"weights of shift {member} are listed twice")
                source = WeightSource(member, given[0])
                own[member] = tuple(given) if len(given) == 3 else (given[0], *(source.column(d) for d in DIRECTIONS))
        shift_sources = []
        for name, targets in _expanded(config.get("shiftSyst", {}), known, "shift").items():
            if not targets:
                raise ValueError(f"shift {name} has no target")
            shift_sources.append(ShiftSource(name, tuple(targets), (ratios or {}).get(name), own.get(name)))
        return cls(channels, wanted, steps, factors, kind.value, weight_sources, shift_sources)


def _has(schema: StructType, name: str) -> bool:
    head, _, tail = name.partition(".")
    if head not in schema.names:
        return False
    if not tail:
        return True
    kind = schema[head].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and tail in kind.elementType.names


def usable_variations(schema: StructType, job: CollectJob) -> tuple[list[tuple[str, str, object]], list[tuple[str, str, str, bool, str]]]:
    """``(kind, direction, source)`` of what the columns allow, and a report of all:
    kind, source, direction, whether it is used, and why not. A weight source needs
    both its columns; a shift is judged for each direction by itself."""
    good, rows = [], []

    def judge(kind: str, source, direction: str, reason: str) -> None:
        if not reason:
            good.append((kind, direction, source))
        rows.append((kind, source.name, direction, not reason, reason))

    for s in job.weight_sources:
        gone = [c for c in (s.factor, s.column("up"), s.column("down")) if not _has(schema, c)]
        reason = f"{s.factor} is no factor of the weight" if s.factor not in job.factors else "missing " + ", ".join(gone) if gone else ""
        for d in DIRECTIONS:
            judge("weight", s, d, reason)
    for s in job.shift_sources:
        for d in DIRECTIONS:
            gone = [c for c in s.needed(d) if not _has(schema, c)]
            judge("shift", s, d, "missing " + ", ".join(gone) if gone else "")
    return good, rows


def _with_shift(df: DataFrame, source: ShiftSource, direction: str) -> tuple[DataFrame, dict[str, str]]:
    """Adds the shifted columns; returns what stands in for what."""

    def moved(value: Column, get) -> Column:
        if source.ratio is None:
            return shifted_value(value, direction, get(source.name))
        return shifted_value(value, direction, corr=get(source.ratio), corr_shifted=get(f"{source.ratio}_{direction}"))

    swap: dict[str, str] = {}
    for target in source.targets:
        head, _, tail = target.partition(".")
        new = shifted_field_name(head, source.name, direction)
        if tail:
            # a second target in the same collection starts from the first one's result
            df = df.withColumn(new, F.transform(swap.get(head, head), lambda o: o.withField(tail, moved(o[tail], lambda n: o[n]))))
        else:
            df = df.withColumn(new, moved(F.col(head), F.col))
        swap[head] = new
    return df, swap


def collect(events: DataFrame, job: CollectJob, channel: str = "channel", factor: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Histograms ``place, channel, sample, weight, var, ix, iy, sumw, sumw2, n`` and the
    report of variations ``kind, source, direction, used, reason``.

    ``place`` is the position of the channel in the job, ``sample`` the merged entry it
    belongs to. Flow goes into the outer bins if the job folds. ``factor`` has a number
    per channel (``channel, factor``) that scales its contents; a channel without one
    keeps them. Events without a value for a variable do not fill it; where a channel
    has no values in a variation's columns it has no histogram of that variation. A
    shift's weight is that of its selection; events that fail it do not count in ``n``.
    """
    spark: SparkSession = events.sparkSession
    good, rows = usable_variations(events.schema, job)
    report = values_table(spark, "kind string, source string, direction string, used boolean, reason string", rows)
    steps = job.steps.hoisted()
    df = events.filter(F.col(channel).isin(*dict.fromkeys(c for c, _ in job.channels)))
    # (suffix, stand-ins, [(name, weight)]) of each selection
    nominal = [(job.weight, weight_product(job.factors))]
    shifted = []
    for kind, d, s in good:
        name = f"{job.weight}_{s.name}_{d}"
        if kind == "weight":
            nominal.append((name, weight_product(job.factors, {s.factor: s.column(d)})))
        else:
            df, swap = _with_shift(df, s, d)
            own = {s.weights[0]: s.weights[1 + DIRECTIONS.index(d)]} if s.weights else {}
            shifted.append((f"__{s.name}_{d}", swap, [(name, weight_product(job.factors, own))]))
    df = df.withColumns({f"_w{k}_{i}": w for k, (_, _, ws) in enumerate([("", {}, nominal), *shifted]) for i, (_, w) in enumerate(ws)})
    for suffix, swap, _ in [("__nominal", {}, nominal), *shifted]:
        df = apply_variant(df, steps, suffix, swap, flags=True, final_flag=f"_pass{suffix}")
    have = set(df.columns)
    defined = {s.name for s in steps if s.defines}

    def value(name: str, suffix: str, swap: dict[str, str]) -> Column:
        column = name + suffix if name in defined else swap.get(name, name)
        if column not in have:
            raise ValueError(f"no column for the variable {name}")
        return F.col(column)

    names: list[list[str]] = []
    entries = []
    for k, (suffix, swap, weights) in enumerate([("__nominal", {}, nominal), *shifted]):
        for at in range(0, len(weights), CHUNK):
            part = range(at, min(at + CHUNK, len(weights)))
            sums = [F.col(f"_w{k}_{i}") for i in part] + [F.lit(None).cast("double")] * (CHUNK - len(part))
            for v, var in enumerate(job.variables):
                bins = [(a.clamped_index if job.fold else a.index)(value(a.var, suffix, swap)) for a in (var.x, var.y) if a]
                ok = F.col(f"_pass{suffix}")
                for b in bins:
                    ok = ok & b.isNotNull()
                second = bins[1] if var.y else F.lit(None).cast("int")
                entry = F.struct(F.lit(len(names)).alias("g"), F.lit(v).alias("v"), bins[0].alias("ix"), second.alias("iy"), *[w.alias(f"w{i}") for i, w in enumerate(sums)])
                entries.append(F.when(ok, entry))
            names.append([weights[i][0] for i in part])
    filled = df.select(F.col(channel).alias("channel"), F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("channel", "e.*")
    moments = [m for i in range(CHUNK) for m in (F.sum(f"w{i}").alias(f"s{i}"), F.sum(F.col(f"w{i}") * F.col(f"w{i}")).alias(f"q{i}"))]
    wide = filled.groupBy("channel", "g", "v", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), *moments)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("sumw"), F.col(f"q{i}").alias("sumw2")) for i in range(CHUNK)])
    label = F.array(*[F.array(*[F.lit(n) for n in group]) for group in names])
    long = wide.select("channel", "g", "v", "ix", "iy", "n", F.inline(F.filter(cells, lambda c: c["sumw"].isNotNull())))
    var = F.array(*[F.lit(v.name) for v in job.variables])
    out = long.select("channel", label[F.col("g")][F.col("i")].alias("weight"), var[F.col("v")].alias("var"), "ix", "iy", "sumw", "sumw2", "n")
    listed = values_table(spark, "place int, channel string, sample string", [(i, c, g) for i, (c, g) in enumerate(job.channels)])
    out = out.join(listed, "channel")
    if factor is not None:
        out = out.join(factor.select(F.col("channel"), F.col("factor").cast("double").alias("factor")), "channel", "left")
        f = F.coalesce("factor", F.lit(1.0))
        out = out.withColumns({"sumw": F.col("sumw") * f, "sumw2": F.col("sumw2") * f * f})
    return out.select("place", "channel", "sample", "weight", "var", "ix", "iy", "sumw", "sumw2", "n"), report
