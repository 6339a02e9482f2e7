"""Algebra on histogram tables.

A histogram set is one table with key columns (channel, variable, variation,
...), bin columns and ``sumw, sumw2, n``. Operations on several histograms of
the set are conditional sums inside one aggregation, not self-joins, so the
fill below them runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators.scale import null_safe_join, written

CONTENT = ("sumw", "sumw2", "n")


def _sums(where: Column | None = None) -> list[Column]:
    pick = (lambda c: F.col(c)) if where is None else (lambda c: F.when(where, F.col(c)))
    return [F.sum(pick(c)).alias(c) for c in CONTENT]


# --- combination ------------------------------------------------------------------


def merge(hists: DataFrame, members: dict[str, str], keys: Sequence[str], channel: str = "channel", edges: Sequence[str] = ()) -> DataFrame:
    """Merge component channels; ``members`` maps component to merged channel,
    components that are not listed keep their own name. With ``edges`` (the columns
    of the bin edges) components whose bins differ by more than 1e-9 are an error."""
    target = None
    for part, whole in members.items():
        cond = F.col(channel) == part
        target = F.when(cond, F.lit(whole)) if target is None else target.when(cond, F.lit(whole))
    named = hists if target is None else hists.withColumn(channel, F.coalesce(target, F.col(channel)))
    out = named.groupBy(channel, *keys).agg(*_sums(), *[F.min(e).alias(e) for e in edges], *[F.max(e).alias(f"_top_{e}") for e in edges])
    for e in edges:
        wrong = F.raise_error(F.concat(F.lit(f"bins of different {e} in "), F.col(channel))).cast("double")
        out = out.withColumn(e, F.when((F.col(f"_top_{e}") != F.col(e)) & (F.col(f"_top_{e}") - F.col(e) > 1e-9), wrong).otherwise(F.col(e))).drop(f"_top_{e}")
    return out


def check_same_binning(hists: DataFrame, group: Sequence[str], bins: Sequence[str] = ("ix",), edges: Sequence[str] = ("x_lo", "x_hi")) -> DataFrame:
    """Groups whose histograms do not share one binning, with the number of bins
    that have different edges (beyond 1e-9). Empty bins are not stored, so bins
    are compared where they exist."""
    spread = [F.max(e) - F.min(e) for e in edges]
    per_bin = hists.groupBy(*group, *bins).agg(F.greatest(*spread, F.lit(0.0)).alias("_gap"))
    return per_bin.filter(F.col("_gap") > 1e-9).groupBy(*group).agg(F.count(F.lit(1)).alias("conflicts"))


def add(sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sum histogram sets key by key; keys of only one set stay."""
    out = sets[0].select(*keys, *CONTENT)
    for s in sets[1:]:
        out = out.unionByName(s.select(*keys, *CONTENT))
    return out.groupBy(*keys).agg(*_sums())


def combine(parts: Sequence[tuple[DataFrame, float]], keys: Sequence[str]) -> DataFrame:
    """Signed sum of sets: contents with the coefficient, squared errors with
    its square. A part that misses a bin counts as zero there."""
    out = None
    for hist, c in parts:
        piece = hist.select(
            *keys, (F.col("sumw") * c).alias("sumw"), (F.col("sumw2") * (c * c)).alias("sumw2"), "n"
        )
        out = piece if out is None else out.unionByName(piece)
    return out.groupBy(*keys).agg(*_sums())


def subtract(hists: DataFrame, keys: Sequence[str], plus: Column, minus: Column) -> DataFrame:
    """(sum of the rows in ``plus``) - (sum of the rows in ``minus``), errors in
    quadrature; nothing to subtract is allowed."""
    sign = F.when(plus, 1.0).when(minus, -1.0)
    rows = hists.filter(plus | minus).select(
        *keys, (F.col("sumw") * sign).alias("sumw"), "sumw2", "n"
    )
    return rows.groupBy(*keys).agg(*_sums())


def rescale(hists: DataFrame, factor: Column) -> DataFrame:
    return hists.withColumns({"sumw": F.col("sumw") * factor, "sumw2": F.col("sumw2") * factor * factor})


def combine_eras(
    hists: DataFrame,
    keys: Sequence[str],
    roles: dict[str, str],
    luminosity: dict[object, float],
    eras: dict[str, Sequence],
    target: Sequence,
    scales: dict[str, float] | None = None,
    channel: str = "channel",
    era: str = "era",
) -> DataFrame:
    """Sum the eras of every role. Measured roles (``data``, ``data_driven``) count as
    they are; simulation of the eras in ``eras[role]`` is scaled to the luminosity of
    the ``target`` eras, and by the scale of its process. An era without luminosity
    or a role without eras is an error; rows of other eras or channels are left out."""
    def total(chosen: Sequence) -> float:
        if not chosen or any(e not in luminosity for e in chosen):
            raise ValueError(f"no luminosity for {list(chosen)}")
        return sum(luminosity[e] for e in chosen)

    factor = F.lit(None).cast("double")
    for c, role in roles.items():
        f = 1.0 if role in ("data", "data_driven") else total(target) / total(eras[role])
        mine = (F.col(channel) == c) & F.col(era).isin(*eras[role])
        factor = F.when(mine, F.lit(f * (scales or {}).get(c, 1.0))).otherwise(factor)
    named = F.lit(None).cast("string")
    for c, role in roles.items():
        named = F.when(F.col(channel) == c, F.lit(role)).otherwise(named)
    rows = hists.withColumns({"_f": factor, "role": named}).filter(F.col("_f").isNotNull())
    return rescale(rows, F.col("_f")).groupBy("role", *keys).agg(*_sums())


def crop(hists: DataFrame, axis: Axis, lo: float, hi: float) -> DataFrame:
    """Bins that lie fully inside [lo, hi], numbered from 1 again."""
    edges = axis.all_edges()
    if lo < edges[0] - 1e-9 or hi > edges[-1] + 1e-9 or hi <= lo:
        raise ValueError(f"range [{lo}, {hi}] does not fit axis {axis.var}")
    inside = [i + 1 for i, (a, b) in enumerate(zip(edges, edges[1:])) if a >= lo - 1e-9 and b <= hi + 1e-9]
    if not inside:
        raise ValueError(f"no bin of {axis.var} lies inside [{lo}, {hi}]")
    first, last = inside[0], inside[-1]
    return hists.filter(F.col("ix").between(first, last)).withColumn("ix", F.col("ix") - (first - 1))


def ratio(hists: DataFrame, keys: Sequence[str], num: Column, den: Column, shapes: bool = False) -> DataFrame:
    """Bin-wise quotient with propagated error; 0 +- 0 where the denominator is
    0. ``shapes`` divides both sides by their integrals first."""
    rows = hists.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(num, F.col("sumw"))), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum(F.when(num, F.col("sumw2"))), F.lit(0.0)).alias("va"),
        F.coalesce(F.sum(F.when(den, F.col("sumw"))), F.lit(0.0)).alias("b"),
        F.coalesce(F.sum(F.when(den, F.col("sumw2"))), F.lit(0.0)).alias("vb"),
    )
    if shapes:
        outer = Window.partitionBy(*[k for k in keys if k not in ("ix", "iy")], F.lit(0))
        for c, v in (("a", "va"), ("b", "vb")):
            rows = rows.withColumn("_t", F.sum(c).over(outer))
            inv = F.when(F.col("_t") != 0, 1.0 / F.col("_t")).otherwise(F.lit(1.0))
            rows = rows.withColumns({c: F.col(c) * inv, v: F.col(v) * inv * inv}).drop("_t")
    a, va, b, vb = (F.col(c) for c in ("a", "va", "b", "vb"))
    return rows.select(
        *keys,
        F.when(b == 0, 0.0).otherwise(a / b).alias("ratio"),
        F.when(b == 0, 0.0).otherwise(F.sqrt(va * b * b + vb * a * a) / (b * b)).alias("error"),
    )


def integral(hists: DataFrame, keys: Sequence[str], nx: int) -> DataFrame:
    return hists.filter(F.col("ix").between(1, nx)).groupBy(*keys).agg(F.sum("sumw").alias("integral"))


def normalise(hists: DataFrame, keys: Sequence[str], nx: int) -> DataFrame:
    """Scale every histogram to unit integral over its visible bins."""
    w = Window.partitionBy(*keys, F.lit(0))
    visible = F.when(F.col("ix").between(1, nx), F.col("sumw"))
    rows = hists.withColumn("_t", F.sum(visible).over(w))
    f = F.when(F.col("_t") != 0, 1.0 / F.col("_t")).otherwise(F.lit(1.0))
    return rescale(rows, f).drop("_t")


# --- completeness -----------------------------------------------------------------


def complete(hists: DataFrame, channels: Sequence[str], variations: Sequence[str], axis: Axis, variation: str = "variation", strict: bool = False) -> DataFrame:
    """Every expected (channel, variation, bin): the variation itself, else the
    nominal of the channel, else zero (or an error when ``strict``).

    The expected keys are generated per stored bin, and a missing histogram is a
    fact about (channel, variation), not about a bin.
    """
    hists = written(hists)  # filled once, used three times
    names = [v for v in variations if v != "nominal"]
    slots = F.array(
        *[F.struct(F.lit(c).alias("channel"), F.lit(v).alias(variation)) for c in channels for v in ["nominal", *names]]
    )
    bins = F.sequence(F.lit(0), F.lit(axis.n + 1))
    spark = hists.sparkSession
    expected = spark.range(1).select(F.inline(slots)).select("channel", variation, F.explode(bins).alias("ix"))
    present = hists.groupBy("channel", variation).agg(F.lit(True).alias("_present"))
    got = hists.select("channel", variation, "ix", *CONTENT)
    nominal = hists.filter(F.col(variation) == "nominal").select(
        "channel", "ix", *[F.col(c).alias(f"_n_{c}") for c in CONTENT]
    )
    out = (
        expected.join(present, ["channel", variation], "left")
        .join(got, ["channel", variation, "ix"], "left")
        .join(nominal, ["channel", "ix"], "left")
    )
    here = F.coalesce(F.col("_present"), F.lit(False))

    def value(c: str, zero: Column) -> Column:
        v = F.when(here, F.coalesce(F.col(c), zero)).otherwise(F.coalesce(F.col(f"_n_{c}"), zero))
        if strict:
            msg = F.concat(F.lit("missing histogram "), F.col("channel"), F.lit(" "), F.col(variation))
            v = F.when(here, F.coalesce(F.col(c), zero)).otherwise(F.raise_error(msg).cast("double"))
        return v.alias(c)

    return out.select(
        "channel", variation, "ix", value("sumw", F.lit(0.0)), value("sumw2", F.lit(0.0)), value("n", F.lit(0)).cast("long").alias("n")
    )


def insert(store: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add histograms to a set; a key that is already there is an error."""
    both = store.select(*keys).distinct().withColumn("_s", F.lit(1)).unionByName(
        new.select(*keys).distinct().withColumn("_s", F.lit(2))
    )
    clash = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    if not clash.isEmpty():
        raise ValueError(f"histogram exists already: {clash.first()}")
    return store.unionByName(new)


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys, keys.columns, "left_anti")


# --- uncertainties ----------------------------------------------------------------


def every_bin(hists: DataFrame, keys: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """The set with a row for every source and direction of a histogram in every bin
    that any of them has: a bin that is not stored is empty, so its content is 0."""
    outer = [k for k in keys if k not in bins]
    stored = written(hists.groupBy(*keys, "source", "direction").agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2")))
    # both sides are lists of one histogram; without outer keys there is one list each
    places = stored.select(*keys).distinct().withColumn("_one", F.lit(1))
    kinds = stored.select(*outer, "source", "direction").distinct().withColumn("_one", F.lit(1))
    grid = null_safe_join(places, kinds, [*outer, "_one"]).drop("_one")
    full = null_safe_join(grid, stored, [*keys, "source", "direction"], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sumw", "sumw2")})


def uncertainty_band(hists: DataFrame, keys: Sequence[str], statistical: bool = False, bins: Sequence[str] = ("ix",)) -> DataFrame:
    """Asymmetric band around the nominal.

    ``hists`` has a column ``source`` (``nominal`` or the variation) and
    ``direction`` (``up``/``down``). Per source the larger upward and the larger
    downward excursion count; sources add in quadrature. A source that lacks one
    direction in the whole histogram does not count; a bin that is not stored is 0.
    """
    by_source = every_bin(hists, keys, bins).groupBy(*keys, "source").agg(
        F.sum(F.when(F.col("source") == "nominal", F.col("sumw"))).alias("nominal"),
        F.sum(F.when(F.col("source") == "nominal", F.col("sumw2"))).alias("stat2"),
        F.sum(F.when(F.col("direction") == "up", F.col("sumw"))).alias("up"),
        F.sum(F.when(F.col("direction") == "down", F.col("sumw"))).alias("down"),
    )
    # the nominal of a bin sits on its own row: spread it, then compare. The
    # window groups hold one row per source.
    w = Window.partitionBy(*keys)
    rows = by_source.withColumns(
        {"_nom": F.coalesce(F.max("nominal").over(w), F.lit(0.0)), "_stat2": F.max("stat2").over(w)}
    ).withColumns({"_du": F.col("up") - F.col("_nom"), "_dd": F.col("down") - F.col("_nom")})
    rise = F.greatest(F.lit(0.0), F.col("_du"), F.col("_dd"))
    fall = F.greatest(F.lit(0.0), -F.col("_du"), -F.col("_dd"))
    paired = F.col("up").isNotNull() & F.col("down").isNotNull()
    out = rows.groupBy(*keys).agg(
        F.max("_nom").alias("nominal"),
        F.coalesce(F.sum(F.when(paired, rise * rise)), F.lit(0.0)).alias("_u"),
        F.coalesce(F.sum(F.when(paired, fall * fall)), F.lit(0.0)).alias("_d"),
        F.max("_stat2").alias("_s"),
    )
    extra = F.coalesce(F.col("_s"), F.lit(0.0)) if statistical else F.lit(0.0)
    return out.select(
        *keys, "nominal", F.sqrt(F.col("_u") + extra).alias("err_up"), F.sqrt(F.col("_d") + extra).alias("err_down")
    )


def ratio_band(band: DataFrame) -> DataFrame:
    """Relative band; 0 where the nominal is 0."""
    zero = F.col("nominal") == 0
    return band.withColumns(
        {
            "err_up": F.when(zero, 0.0).otherwise(F.col("err_up") / F.col("nominal")),
            "err_down": F.when(zero, 0.0).otherwise(F.col("err_down") / F.col("nominal")),
        }
    )


def factor_variations(hists: DataFrame, keys: Sequence[str], factors: dict[str, tuple[float, float]], source: str, channel: str = "channel") -> DataFrame:
    """Up and down totals of a set when each channel is scaled by its
    ``(down, up)`` factors; other channels stay at 1."""

    def scaled(which: int) -> Column:
        f = None
        for chan, pair in factors.items():
            cond = F.col(channel) == chan
            f = F.when(cond, F.lit(pair[which])) if f is None else f.when(cond, F.lit(pair[which]))
        return F.lit(1.0) if f is None else f.otherwise(F.lit(1.0))

    both = F.array(
        F.struct(F.lit("down").alias("direction"), scaled(0).alias("_f")),
        F.struct(F.lit("up").alias("direction"), scaled(1).alias("_f")),
    )
    rows = hists.select(*keys, "sumw", "sumw2", "n", channel, F.inline(both))
    return (
        rescale(rows, F.col("_f"))
        .groupBy(*keys, "direction")
        .agg(*_sums())
        .withColumn("source", F.lit(source))
    )


def relative_variation(hists: DataFrame, channel: str, r: float) -> DataFrame:
    """Rows of a relative uncertainty on one channel: contents times 1+-r, not
    below 0; other channels keep the nominal."""
    mine = F.col("channel") == channel
    both = F.array(
        F.struct(F.lit("up").alias("direction"), F.lit(1.0 + r).alias("_f")),
        F.struct(F.lit("down").alias("direction"), F.lit(1.0 - r).alias("_f")),
    )
    rows = hists.select("*", F.inline(both))
    value = F.when(mine, F.greatest(F.lit(0.0), F.col("sumw") * F.col("_f"))).otherwise(F.col("sumw"))
    return rows.withColumns({"sumw": value, "source": F.lit("relative")}).drop("_f")


def max_variation(hists: DataFrame, keys: Sequence[str], bins: Sequence[str] = ("ix",)) -> DataFrame:
    """Per bin the largest upward and the most downward variation with their
    errors; a bin never moves past the nominal (``source = 'nominal'``). A bin that
    is not stored is 0."""
    w = Window.partitionBy(*keys)
    hists = every_bin(hists, keys, bins)
    nominal = F.max(F.when(F.col("source") == "nominal", F.col("sumw"))).over(w)
    nominal_err = F.max(F.when(F.col("source") == "nominal", F.col("sumw2"))).over(w)
    zero = F.lit(0.0)
    rows = hists.withColumns({"_nom": F.coalesce(nominal, zero), "_nerr": F.coalesce(nominal_err, zero)}).withColumn("_d", F.col("sumw") - F.col("_nom"))
    out = rows.groupBy(*keys).agg(
        F.max("_nom").alias("nominal"),
        F.max("_nerr").alias("_nerr"),
        F.max("_d").alias("_up"),
        F.min("_d").alias("_down"),
        F.max_by("sumw2", F.struct("_d", "sumw2")).alias("_ue"),
        F.min_by("sumw2", F.struct("_d", "sumw2")).alias("_de"),
    )
    return out.select(
        *keys,
        "nominal",
        (F.col("nominal") + F.greatest(F.lit(0.0), F.col("_up"))).alias("upper"),
        F.sqrt(F.when(F.col("_up") > 0, F.col("_ue")).otherwise(F.col("_nerr"))).alias("upper_error"),
        (F.col("nominal") + F.least(F.lit(0.0), F.col("_down"))).alias("lower"),
        F.sqrt(F.when(F.col("_down") < 0, F.col("_de")).otherwise(F.col("_nerr"))).alias("lower_error"),
    )


# --- presentation tables ----------------------------------------------------------


def blind(hists: DataFrame, axis: Axis, ranges: Sequence[tuple[float, float]], keys: Sequence[str] = ()) -> DataFrame:
    """Bins whose centre lies in a closed range: content -1, error 0, also where
    nothing was stored for a histogram (named by ``keys``)."""
    edges = axis.all_edges()
    centers = [0.5 * (a + b) for a, b in zip(edges, edges[1:])]
    hidden = [i + 1 for i, c in enumerate(centers) if any(lo <= c <= hi for lo, hi in ranges)]
    if not hidden:
        return hists
    own = [*keys, "ix"]
    extra = [c for c in hists.columns if c not in (*own, *CONTENT)]
    if extra:
        raise ValueError(f"columns {extra} neither name a histogram nor are contents")
    slots = hists.select(*keys).distinct() if keys else hists.select(F.lit(1).alias("_one")).distinct()
    slots = slots.withColumn("ix", F.explode(F.array(*[F.lit(i).cast(hists.schema["ix"].dataType) for i in hidden])))
    counts = hists.filter(F.col("ix").isin(*hidden)).select(*own, F.col("n").alias("_n"))
    masked = null_safe_join(slots, counts, own, "left").select(
        *own, F.lit(-1.0).alias("sumw"), F.lit(0.0).alias("sumw2"), F.coalesce("_n", F.lit(0)).cast(hists.schema["n"].dataType).alias("n")
    )
    seen = hists.filter(~F.coalesce(F.col("ix").isin(*hidden), F.lit(False)))
    return seen.unionByName(masked.select(*hists.columns))


def stack_order(hists: DataFrame, nx: int, floor: float = 1e-6, channel: str = "channel") -> DataFrame:
    """Channels by rising integral; those at or below ``floor`` are left out."""
    tot = integral(hists, [channel], nx).filter(F.col("integral") > floor)
    # one row per channel: the window sees the channel list, not data
    return tot.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("integral", channel)))


def nice_scale(reference: Column, signal: Column) -> Column:
    """Largest of 1, 2, 5 times a power of ten not above reference / signal,
    at least 1."""
    r = reference / F.when(signal > 0, signal)
    base = F.pow(F.lit(10.0), F.floor(F.log10(r)))
    pick = F.when(5 * base <= r, 5 * base).when(2 * base <= r, 2 * base).otherwise(base)
    return F.when((reference > 0) & (signal > 0) & (r >= 1), pick).otherwise(F.lit(1.0)).cast("int")


def smallest_positive(hists: DataFrame, nx: int) -> DataFrame:
    """Smallest positive content (0 when none) and the power of ten below it."""
    pos = F.min(F.when((F.col("sumw") > 0) & F.col("ix").between(1, nx), F.col("sumw")))
    low = hists.agg(F.coalesce(pos, F.lit(0.0)).alias("smallest"))
    floor = F.when(F.col("smallest") > 0, F.pow(F.lit(10.0), F.floor(F.log10("smallest")) - 1)).otherwise(F.lit(0.0))
    return low.withColumn("log_floor", floor)


def clip_negative(hists: DataFrame, floor: float = 0.0) -> DataFrame:
    """Raise negative contents to the floor and mark them."""
    bad = F.col("sumw") < floor
    return hists.withColumns({"clipped": bad, "sumw": F.greatest(F.col("sumw"), F.lit(floor))})


# --- templates over campaigns -----------------------------------------------------


def merge_campaigns(hists: DataFrame, keys: Sequence[str], scale_after: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Merge campaigns per (keys, variation, bin).

    Nominal inputs with zero integral are skipped. A variation falls back to the
    nominal of a campaign that lacks it, and exists only if some campaign has it.
    ``hists`` has the columns campaign, variation (``nominal`` or name) and ix.
    """
    hists = written(hists)  # filled once, used several times
    totals = hists.groupBy(*keys, "campaign", "variation").agg(F.sum("sumw").alias("_t"))
    per_campaign = totals.groupBy(*keys, "campaign").agg(F.collect_set("variation").alias("_have"))
    wanted = totals.filter("variation != 'nominal'").groupBy(*keys).agg(F.collect_set("variation").alias("_want"))
    plan = null_safe_join(per_campaign, wanted, keys, "left").select(
        *keys, "campaign", F.col("_have"), F.explode(F.concat(F.array(F.lit("nominal")), F.coalesce("_want", F.array().cast("array<string>")))).alias("target")
    )
    # which stored variation feeds which target, one row per (campaign, target)
    feed = plan.withColumn(
        "variation", F.when(F.array_contains("_have", F.col("target")), F.col("target")).otherwise(F.lit("nominal"))
    )
    feed = null_safe_join(feed, totals, [*keys, "campaign", "variation"])
    feed = feed.filter((F.col("target") != "nominal") | (F.col("_t") != 0)).select(*keys, "campaign", "variation", "target")
    rows = null_safe_join(hists, feed, [*keys, "campaign", "variation"]).groupBy(*keys, F.col("target").alias("variation"), "ix").agg(*_sums())
    return clip_negative(rescale(rows, F.lit(scale_after)), floor).drop("clipped")


def template_table(hists: DataFrame, keys: Sequence[str], process: str = "process") -> DataFrame:
    """Per key and process the rate and its share of the summed rates, plus the
    variations usable as shapes (both directions with positive integral).

    ``hists`` has variation (``nominal`` or the source) and direction."""
    sums = hists.groupBy(*keys, process, "variation").agg(
        F.sum("sumw").alias("t"),
        F.sum(F.when(F.col("direction") == "up", F.col("sumw"))).alias("u"),
        F.sum(F.when(F.col("direction") == "down", F.col("sumw"))).alias("d"),
    )
    rate = sums.groupBy(*keys, process).agg(
        F.sum(F.when(F.col("variation") == "nominal", F.col("t"))).alias("rate"),
        F.count_if((F.col("variation") != "nominal") & (F.col("u") > 0) & (F.col("d") > 0)).alias("n_shapes"),
    )
    return rate.withColumn("observation", F.sum("rate").over(Window.partitionBy(*keys, F.lit(0))))


# --- channel roles and stack totals ------------------------------------------------


def chosen(spec: Sequence[str] | dict[str, object]) -> list[str]:
    """Channels of a list, or those with a true flag in a map."""
    return [c for c, flag in spec.items() if flag] if isinstance(spec, dict) else list(spec)


def channel_roles(channels: Sequence[str], data=(), data_driven=(), signal=(), stack=None, overlay=None) -> dict[str, set[str]]:
    """Roles of every channel. By default simulation that is no signal and
    data-driven channels are stacked, and simulation that is not stacked is
    overlaid. A channel cannot be data and data-driven."""
    is_data, is_dd, is_signal = set(chosen(data)), set(chosen(data_driven)), set(chosen(signal))
    if is_data & is_dd:
        raise ValueError(f"both data and data-driven: {sorted(is_data & is_dd)}")
    stacked = set(chosen(stack)) if stack is not None else set(channels) - is_data - is_signal
    overlaid = set(chosen(overlay)) if overlay is not None else set(channels) - is_data - is_dd - stacked
    named = {"data": is_data, "data_driven": is_dd, "signal": is_signal, "stack": stacked, "overlay": overlaid}
    unknown = set().union(*named.values()) - set(channels)
    if unknown:
        raise ValueError(f"unknown channels {sorted(unknown)}")
    return {c: {r for r, members in named.items() if c in members} for c in channels}


def stack_total(hists: DataFrame, keys: Sequence[str], roles: dict[str, set[str]], vary: str = "mc", variation: str = "variation") -> DataFrame:
    """Stack total per variation: the varied part (``mc`` or ``dd``) follows the
    variation, the other part stays nominal. ``hists`` is complete, that is it
    has every variation of every channel.

    The moving part is summed per variation, the fixed part once, and the sums meet in
    one join on the bins; no list of variations is made. A bin that only the fixed part
    has stands under the nominal.
    """
    stacked = [c for c, r in roles.items() if "stack" in r]
    dd = [c for c in stacked if "data_driven" in roles[c]]
    moving = F.col("channel").isin(*[c for c in stacked if (c in dd) == (vary == "dd")])
    rows = written(hists.filter(F.col("channel").isin(*stacked)).select("channel", *keys, variation, *CONTENT))
    moved = rows.filter(moving).groupBy(*keys, variation).agg(*_sums())
    still = rows.filter(~moving & (F.col(variation) == "nominal")).groupBy(*keys).agg(*[F.sum(c).alias(f"_f_{c}") for c in CONTENT])
    side = still.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    both = moved.join(side, [moved[k].eqNullSafe(side[f"_k_{k}"]) for k in keys], "full")
    zero = {"sumw": F.lit(0.0), "sumw2": F.lit(0.0), "n": F.lit(0).cast("long")}
    return both.select(
        *[F.coalesce(k, f"_k_{k}").alias(k) for k in keys],
        F.coalesce(variation, F.lit("nominal")).alias(variation),
        *[(F.coalesce(F.col(c), zero[c]) + F.coalesce(F.col(f"_f_{c}"), zero[c])).alias(c) for c in CONTENT],
    )
