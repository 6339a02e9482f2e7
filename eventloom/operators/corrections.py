"""Correction chains: registered ``DataFrame -> DataFrame`` functions.

Collections are ``ARRAY<STRUCT>``; per-object results become struct fields,
per-event results columns. A module skips what exists already, so a chain can be
applied to tables that went through part of it. Calibration tables are
``BinnedTable`` values in ``Context.tables``.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import vectors as V
from eventloom.functions.kinematics import delta_phi, folded_delta_r
from eventloom.operators.lookup import BinnedTable, Lookup, StoredTable, interval_value, looked_up_fields, side_by_side
from eventloom.operators.scale import keyed_uniform
from eventloom.operators.variations import quadrature_shift


@dataclass
class Context:
    era: str = ""
    dataset: str = ""
    tables: dict[str, BinnedTable | StoredTable] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    #: columns that name an event, for tables too large to go into the plan
    key: Sequence[str] = ()
    options: dict[str, dict] = field(default_factory=dict)


REGISTRY: dict[str, Callable] = {}


def correction(name: str):
    """Register a module. Options of the job are passed by keyword, as far as
    the module takes them."""

    def wrap(fn: Callable) -> Callable:
        REGISTRY[name] = fn
        return fn

    return wrap


def apply_corrections(df: DataFrame, names: Sequence[str], ctx: Context) -> DataFrame:
    for name in names:
        fn = REGISTRY[name]
        accepted = inspect.signature(fn).parameters
        opts = {k: v for k, v in ctx.options.get(name, {}).items() if k in accepted}
        df = fn(df, ctx, **opts)
    return without_helpers(df)


def without_helpers(df: DataFrame) -> DataFrame:
    """Drop the helper fields (leading underscore) of all collections."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType
        if kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            extra = [n for n in kind.elementType.names if n.startswith("_")]
            if extra:
                out[f.name] = _drop_fields(f.name, extra)
    return df.withColumns(out) if out else df


def _drop_fields(coll: str, names: Sequence[str]) -> Column:
    return F.transform(coll, lambda o: o.dropFields(*names))


def element_fields(df: DataFrame, coll: str) -> set[str]:
    return set(df.schema[coll].dataType.elementType.names)


def add_fields(df: DataFrame, coll: str, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Add struct fields that are not there yet. All of them are computed from
    the object as it was, so a field that needs another one comes in a later
    call and expressions never nest into each other."""
    have = element_fields(df, coll)
    todo = {n: f for n, f in fields.items() if n not in have}
    if not todo:
        return df

    def extend(o: Column) -> Column:
        out = o
        for n, f in todo.items():
            out = out.withField(n, f(o))
        return out

    return df.withColumn(coll, F.transform(coll, extend))


def add_looked_up(df: DataFrame, ctx: Context, coll: str, *stages: dict[str, Callable[[Column], Column] | Lookup]) -> DataFrame:
    """Like ``add_fields`` in several stages, whose fields may be lookups in tables of
    any size. Fields that are there stay as they are."""
    have = element_fields(df, coll)
    todo = [{n: f for n, f in stage.items() if n not in have} for stage in stages]
    return looked_up_fields(df, coll, [s for s in todo if s], ctx.key) if any(todo) else df


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute derived columns once before filters that use them.

    Spark moves a filter below the projection that defines its columns and so
    evaluates long expressions again for it. A one-element generator in between
    keeps the filter above and yields the same rows.
    """
    rest = [c for c in df.columns if c not in names]
    once = F.inline_outer(F.array(F.struct(*[F.col(n) for n in names])))
    return df.select(*rest, once).select(*df.columns)


def add_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns({n: c for n, c in cols.items() if n not in df.columns})


# --- jets ------------------------------------------------------------------------


@correction("jet_scale_mc")
def jet_scale_mc(df: DataFrame, ctx: Context, coll: str = "jets", with_phi: bool = False) -> DataFrame:
    """Undo the stored calibration and apply the level-2 factor to pt and mass."""
    t = ctx.tables["l2"]

    def raw(o: Column) -> Column:
        return o["pt"] * (1.0 - o["raw"])

    level_2 = Lookup(t, lambda o: (o["eta"], o["phi"], raw(o)) if with_phi else (o["eta"], raw(o)))
    return add_looked_up(
        df, ctx, coll, {"l2": level_2}, {"pt_jec": lambda o: raw(o) * o["l2"], "mass_jec": lambda o: o["mass"] * (1.0 - o["raw"]) * o["l2"]}
    )


@correction("jet_scale_data")
def jet_scale_data(df: DataFrame, ctx: Context, coll: str = "jets", run: str = "run", use_run: bool = True, with_phi: bool = False) -> DataFrame:
    """Level-2 factor, then the residual by run, eta and the pt after level 2.
    Eras differ in whether run and phi are inputs."""
    l2, res = ctx.tables["l2"], ctx.tables["residual"]

    def raw(o: Column) -> Column:
        return o["pt"] * (1.0 - o["raw"])

    def residual(o: Column) -> Sequence[Column]:
        after = raw(o) * o["l2"]
        return (F.col(run), o["eta"], after) if use_run else (o["eta"], after)

    return add_looked_up(
        df,
        ctx,
        coll,
        {"l2": Lookup(l2, lambda o: (o["eta"], o["phi"], raw(o)) if with_phi else (o["eta"], raw(o)))},
        {"residual": Lookup(res, residual)},
        {
            "pt_jec": lambda o: raw(o) * o["l2"] * o["residual"],
            "mass_jec": lambda o: o["mass"] * (1.0 - o["raw"]) * o["l2"] * o["residual"],
        },
    )


@correction("jet_scale_sources")
def jet_scale_sources(df: DataFrame, ctx: Context, coll: str = "jets", sources: Sequence[str] = (), pt: str = "pt_jec") -> DataFrame:
    """Relative uncertainty of every source as an own field."""
    t = ctx.tables["scale_sources"]
    if not sources:
        return df
    if not t.inline:
        return add_looked_up(df, ctx, coll, {s: Lookup(t, lambda o, s=s: (s, o["eta"], o[pt])) for s in sources})
    df = add_fields(df, coll, {"_scale_cell": lambda o: t.fixed(sources[0]).cell(o["eta"], o[pt])})
    return add_fields(df, coll, {s: (lambda o, s=s: t.fixed(s).value(o["_scale_cell"])) for s in sources})


@correction("jet_smear")
def jet_smear(
    df: DataFrame, ctx: Context, coll: str = "jets", gen: str = "genjets", link: str = "gen_idx", pt: str = "pt_jec", rho: str = "rho", key: Sequence[str] = ("event",)
) -> DataFrame:
    """Resolution smearing by the hybrid method, nominal, up and down.

    With a generator partner (dR < 0.2 and |dpt| < 3 resolution * pt) the
    difference is scaled; without one a normal number drawn from the event key
    and the position widens the distribution, if the scale factor exceeds 1.
    """
    reso, sf = ctx.tables["resolution"], ctx.tables["resolution_sf"]
    # the draw needs the position, so it is prepared outside the struct update
    if "_draw" not in element_fields(df, coll):
        cols = [F.col(k) for k in key]

        def draw(o: Column, i: Column) -> Column:
            u1 = keyed_uniform(*cols, i, seed="u1")
            u2 = keyed_uniform(*cols, i, seed="u2")
            # Box-Muller; 1 - u is never 0
            normal = F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(F.lit(6.283185307179586) * u2)
            width = reso.at(o["eta"], o[pt], F.col(rho))
            return o.withField("_draw", normal).withField("_reso", width)

        df = df.withColumn(coll, F.transform(coll, draw))

    def partner_pt(o: Column) -> Column:
        g = F.get(F.col(gen), o[link])
        dphi = delta_phi(g["phi"], o["phi"])
        deta = g["eta"] - o["eta"]
        near = dphi * dphi + deta * deta < 0.04
        alike = F.abs(g["pt"] - o[pt]) < 3.0 * o["_reso"] * o[pt]
        return F.when(near & alike, g["pt"])

    df = add_fields(df, coll, {"_partner": partner_pt, "_sf_cell": lambda o: sf.fixed("nom").cell(o["eta"], o[pt])})
    df = add_fields(df, coll, {f"_sf_{v}": (lambda o, v=v: sf.fixed(v).value(o["_sf_cell"])) for v in ("nom", "up", "down")})

    def smear(variation: str) -> Callable[[Column], Column]:
        def one(o: Column) -> Column:
            s = o[f"_sf_{variation}"]
            matched = 1.0 + (s - 1.0) * (o[pt] - o["_partner"]) / o[pt]
            free = 1.0 + o["_draw"] * o["_reso"] * F.sqrt(F.greatest(s * s - 1.0, F.lit(0.0)))
            return F.greatest(F.lit(0.0), F.when(o["_partner"].isNotNull(), matched).otherwise(free))

        return one

    return add_fields(df, coll, {"jer": smear("nom"), "jer_up": smear("up"), "jer_down": smear("down")})


def jet_identification(o: Column, style: str) -> Column:
    """Tight identification by |eta| region: from energy fractions and
    multiplicities (``fractions``) or from the stored bit (``bits``)."""
    a = F.abs(o["eta"])
    if style == "fractions":
        return (
            ((a <= 2.6) & (o["neHEF"] < 0.99) & (o["neEmEF"] < 0.90) & (o["chMult"] + o["neMult"] > 1) & (o["chHEF"] > 0.01) & (o["chMult"] > 0))
            | ((a > 2.6) & (a <= 2.7) & (o["neHEF"] < 0.90) & (o["neEmEF"] < 0.99))
            | ((a > 2.7) & (a <= 3.0) & (o["neHEF"] < 0.99))
            | ((a > 3.0) & (o["neMult"] >= 2) & (o["neEmEF"] < 0.4))
        )
    tight = V.has_bit(o["jetId"], 1)
    return tight & (
        (a <= 2.7) | ((a > 2.7) & (a <= 3.0) & (o["neHEF"] < 0.99)) | ((a > 3.0) & (o["neEmEF"] < 0.4))
    )


#: fixed values: largest muon and charged electromagnetic fraction of a jet that is no
#: lepton, the |eta| up to which they are known, and the electromagnetic sum of loose jets
LEPTON_FRACTION, LEPTON_ETA, LOOSE_SUM = 0.8, 2.7, 0.9


def no_lepton(o: Column) -> Column:
    """The jet is not a misidentified lepton; forward jets are not tested."""
    inside = F.abs(o["eta"]) <= LEPTON_ETA
    return ~inside | ((o["muEF"] < LEPTON_FRACTION) & (o["chEmEF"] < LEPTON_FRACTION))


def identified(style: str) -> Callable[[Column], Column]:
    """Tight identification with the lepton veto."""
    return lambda o: jet_identification(o, style) & no_lepton(o)


def loose_jet(o: Column) -> Column:
    """Jets that the veto map may reject an event for, beside pt and identification."""
    return (o["neEmEF"] + o["chEmEF"]) < LOOSE_SUM


@correction("jet_veto")
def jet_veto(
    df: DataFrame,
    ctx: Context,
    coll: str = "jets",
    leptons: Sequence[str] = ("muons",),
    identify: Callable[[Column], Column] = identified("bits"),
    loose: Callable[[Column], Column] = loose_jet,
    pt: str = "pt_jec",
    shifts: dict[str, Callable[[Column], Column]] | None = None,
    good_pt: float = 30.0,
    max_eta: float = 2.5,
    min_dr: float = 0.4,
) -> DataFrame:
    """Veto map, event weight and good-jet mask.

    An event weight is 1 when no loose jet above 15 lies in a vetoed cell. The
    good-jet mask also asks for a distance to the selected leptons: muons, one
    muon, or electrons and muons, as given by ``leptons`` (collections that
    hold only selected objects). ``shifts`` adds a weight per shifted pt.
    """
    vmap = ctx.tables["veto_map"]
    cell = Lookup(vmap, lambda o: (V.clamp(o["eta"], -5.191, 5.191), V.clamp(o["phi"], -3.1415, 3.1415)))
    if "pass_veto" not in element_fields(df, coll):
        df = add_looked_up(df, ctx, coll, {"_veto": cell}, {"pass_veto": lambda o: o["_veto"] == 0.0})
    df = add_fields(df, coll, {"id_tight": identify})

    def weight(value: Callable[[Column], Column]) -> Column:
        bad = F.exists(F.col(coll), lambda o: (value(o) > 15.0) & o["id_tight"] & loose(o) & ~o["pass_veto"])
        return F.when(bad, 0.0).otherwise(F.lit(1.0))

    cols = {"veto_weight": weight(lambda o: o[pt])}
    for name, value in (shifts or {}).items():
        cols[f"veto_weight_{name}"] = weight(value)
    df = add_columns(df, cols)
    refs = [F.transform(F.col(c), lambda r: F.struct(r["eta"].alias("eta"), r["phi"].alias("phi"))) for c in leptons]
    refs = refs[0] if len(refs) == 1 else F.concat(*refs)
    df = df.withColumn("_refs", refs)
    df = add_fields(df, coll, {"tight_no_pt": lambda o: (F.abs(o["eta"]) < max_eta) & (o["raw"] < 0.9) & o["id_tight"]})

    def dr(o: Column) -> Column:
        near = F.array_min(F.transform(F.col("_refs"), lambda r: V.delta_r(r["eta"], r["phi"], o["eta"], o["phi"])))
        return F.when(o["tight_no_pt"], F.least(F.coalesce(near, F.lit(999.0)), F.lit(999.0))).otherwise(F.lit(0.0))

    df = add_fields(df, coll, {"dr_lepton": dr}).drop("_refs")
    return add_fields(df, coll, {"good": lambda o: (o[pt] > good_pt) & o["tight_no_pt"] & (o["dr_lepton"] > min_dr)})


# --- event weights ---------------------------------------------------------------


@correction("pileup")
def pileup(df: DataFrame, ctx: Context, count: str = "n_true", out: str = "pu_weight") -> DataFrame:
    """Pile-up weight by the count clamped to 0..99, nominal, up and down."""
    t = ctx.tables["pileup"]
    n = V.clamp(F.col(count).cast("double"), 0.0, 99.0)
    names = {"nominal": out, "up": f"{out}_up", "down": f"{out}_down"}
    return add_columns(df, {c: t.at(v, n) for v, c in names.items()})


def tag_weight(coll: Column, sf: Callable[[Column], Column], eff: Callable[[Column], Column], tagged: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
    """Product of SF for tagged and (1 - SF eff) / (1 - eff) for other good jets."""

    def factor(o: Column) -> Column:
        def value(v: Column) -> Column:
            e, s = v["e"], v["s"]
            # e < 1 in this branch, NULLIF keeps the other branch from dividing
            free = F.when(e < 1.0, (1.0 - s * e) / F.nullif(1.0 - e, F.lit(0.0))).otherwise(F.lit(1.0))
            return F.when(tagged(o), s).otherwise(free)

        return V.bind(F.struct(eff(o).alias("e"), sf(o).alias("s")), value)

    return V.product(coll, factor, good)


def _tag_products(sf: np.ndarray, eff: np.ndarray, point_of: Sequence[int], cuts: Sequence[float]) -> Callable:
    """Products of the factors of all parts over the jets (light, sf_cell, eff_cell,
    score) of an event, for a batch of events at once. ``sf`` and ``eff`` have a row per
    cell. An event with a missing number gets null."""
    of, cut = np.asarray(point_of), np.asarray(cuts)[list(point_of)]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def products(jets: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(jets), 0).to_numpy(zero_copy_only=False)
        event = np.repeat(np.arange(len(jets)), sizes)
        parts = jets.flatten().flatten()
        there = jets.is_valid().to_numpy(zero_copy_only=False)
        fine = np.ones(len(event), bool)
        for p in parts:
            fine &= p.is_valid().to_numpy(zero_copy_only=False)
        light, sf_cell, eff_cell, score = (pc.fill_null(p, 0 if pa.types.is_integer(p.type) else False if pa.types.is_boolean(p.type) else 0.0).to_numpy(zero_copy_only=False) for p in parts)
        there[event[~fine | np.isnan(score)]] = False
        nth = np.arange(len(event)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.ones((len(jets), len(of)))
        for rows in np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1]):
            s = np.where(light[rows, None], 1.0, sf[sf_cell[rows]])
            e = eff[eff_cell[rows]][:, of]
            free = np.where(e < 1.0, (1.0 - s * e) / np.where(e < 1.0, 1.0 - e, 1.0), 1.0)
            out[event[rows]] *= np.where(score[rows, None] > cut, s, free)
        ends = np.concatenate([[0], np.cumsum(there) * len(of)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out[there].ravel()), mask=pa.array(~there))

    return products


@correction("btag_working_point")
def btag_working_point(
    df: DataFrame, ctx: Context, coll: str = "jets", points: dict[str, float] | None = None, sources: Sequence[str] = (), source_point: str = "M", pt: str = "pt_jec", out: str = "btag_weight"
) -> DataFrame:
    """Fixed working points: scale factor (1 for light jets), efficiency, event
    weight per point with up and down, and for one point every source up and
    down with their one-sided quadrature totals."""
    sf_t, eff_t = ctx.tables["btag_sf"], ctx.tables["btag_eff"]
    points = points or {"M": 0.1272}

    def where(o: Column) -> tuple[Column, Column]:
        return F.abs(V.clamp(o["eta"], -2.49, 2.49)), V.clamp(o[pt], 20.1, 999.9)

    # all parts of a table share one cell number, found once per jet, and lie side by side
    names = list(points)
    parts = [(syst, wp) for wp in names for syst in ("central", "up", "down")]
    parts += [(f"{d}_{s}", source_point) for s in sources for d in ("up", "down")]
    sf_at = side_by_side([sf_t.fixed(*part).values for part in parts])
    eff_at = side_by_side([eff_t.fixed(wp).values for wp in names])
    df = add_fields(
        df,
        coll,
        {
            "_sf_cell": lambda o: sf_t.fixed("central", names[0]).cell(o["flavour"], *where(o)),
            "_eff_cell": lambda o: eff_t.fixed(names[0]).cell(o["flavour"], *where(o)),
        },
    )
    ones = F.array_repeat(F.lit(1.0), len(parts))
    sf_of = lambda o: F.when(o["flavour"] == 0, ones).otherwise(sf_at(o["_sf_cell"]))
    point_of = [names.index(wp) for _, wp in parts]
    points_of, cuts = F.lit(point_of), V.double_array([points[wp] for wp in names])

    def factors(o: Column) -> Column:
        def one(s: Column, i: Column, eff: Column) -> Column:
            no = F.get(points_of, i)
            e = F.get(eff, no)
            # e < 1 in this branch, NULLIF keeps the other branch from dividing
            free = F.when(e < 1.0, (1.0 - s * e) / F.nullif(1.0 - e, F.lit(0.0))).otherwise(F.lit(1.0))
            return F.when(o["score"] > F.get(cuts, no), s).otherwise(free)

        return V.bind(eff_at(o["_eff_cell"]), lambda eff: F.transform(sf_of(o), lambda s, i: one(s, i, eff)))

    # all events of a batch at once; one with a missing number is walked through in its
    # row. The fields of the jets come after, so they cost nothing where none is used
    sf_rows = np.array([sf_t.fixed(*part).values for part in parts], dtype=np.float64).T
    eff_rows = np.array([eff_t.fixed(wp).values for wp in names], dtype=np.float64).T
    used = F.filter(coll, lambda o: o["good"])
    light = lambda o: (o["flavour"] == 0).alias("light")
    sent = F.transform(used, lambda o: F.struct(light(o), o["_sf_cell"].alias("s"), o["_eff_cell"].alias("e"), o["score"].cast("double").alias("x")))
    df = settle(df.withColumn("_batch", _tag_products(sf_rows, eff_rows, point_of, [points[wp] for wp in names])(sent)), "_batch")
    df = df.withColumn("_weights", F.coalesce("_batch", V.products(used, factors, len(parts)))).drop("_batch")

    df = add_fields(df, coll, {"_sf": sf_of, "_eff": lambda o: eff_at(o["_eff_cell"])})
    values = {}
    for no, wp in enumerate(names):
        values |= {f"sf_{wp}{suffix}": (lambda o, i=3 * no + k: F.get(o["_sf"], F.lit(i))) for k, suffix in enumerate(("", "_up", "_down"))}
        values[f"eff_{wp}"] = lambda o, no=no: F.get(o["_eff"], F.lit(no))
    df = add_fields(df, coll, values)
    columns = [f"{out}_{wp}{suffix}" for wp in names for suffix in ("", "_up", "_down")]
    varied = [f"{out}_{s}_{d}" for s in sources for d in ("up", "down")]
    df = add_columns(df, {n: F.get("_weights", F.lit(i)) for i, n in enumerate(columns + varied)}).drop("_weights")
    df = add_columns(df, {out: F.col(f"{out}_{source_point}")})
    if varied:
        shifts = [F.col(c) for c in varied]
        df = add_columns(df, {f"{out}_total_up": quadrature_shift(F.col(out), shifts, True), f"{out}_total_down": quadrature_shift(F.col(out), shifts, False)})
    return df


#: fixed values: flavours a shape source acts on
SHAPE_FLAVOURS = {
    "cferr1": (4,),
    "cferr2": (4,),
    "lf": (0, 5),
    "lfstats1": (0, 5),
    "lfstats2": (0, 5),
    "hf": (0, 5),
    "hfstats1": (0, 5),
    "hfstats2": (0, 5),
}

#: fixed values: tag thresholds by era of the older combined weight
ERA_THRESHOLDS = {
    "2024": 0.1272,
    "2023": 0.1917,
    "2023BPix": 0.1919,
    "2022": 0.245,
    "2022EE": 0.2605,
}


@correction("btag_shape")
def btag_shape(df: DataFrame, ctx: Context, coll: str = "jets", sources: Sequence[str] = (), pt: str = "pt_jec", out: str = "btag_shape") -> DataFrame:
    """Shape weight: SF by flavour, eta, pt and score, 1 outside its validity;
    a source changes only jets of its flavours; product over good jets."""
    t = ctx.tables["btag_shape"]

    def where(o: Column) -> tuple[Column, Column, Column]:
        return F.abs(V.clamp(o["eta"], -2.49, 2.49)), V.clamp(o[pt], 20.1, 199.9), V.clamp(o["score"], 0.0001, 1.0999)

    df = add_fields(
        df,
        coll,
        {
            "_shape_cell": lambda o: t.fixed("central").cell(o["flavour"], *where(o)),
            "_shape_valid": lambda o: (F.abs(o["eta"]) <= 2.5) & o["id_tight"] & (o["score"] >= 0.0),
        },
    )

    # where a source does not act on a flavour, its part holds the central values; the
    # flavour is the first key of a cell
    known = t.categories[1][1]
    central = t.fixed("central").values
    size = len(central) // len(known)
    parts = [central]
    for s in sources:
        acts = [known[i // size] in SHAPE_FLAVOURS[s] for i in range(len(central))]
        parts += [[v if on else c for v, c, on in zip(t.fixed(f"{d}_{s}").values, central, acts)] for d in ("up", "down")]
    at = side_by_side(parts)
    ones = F.array_repeat(F.lit(1.0), len(parts))
    factors = lambda o: F.when(o["_shape_valid"], at(o["_shape_cell"])).otherwise(ones)
    df = df.withColumn("_weights", V.products(F.filter(coll, lambda o: o["good"]), factors, len(parts)))
    names = [out] + [f"{out}_{s}_{d}" for s in sources for d in ("up", "down")]
    return add_columns(df, {n: F.get("_weights", F.lit(i)) for i, n in enumerate(names)}).drop("_weights")


# --- muons -----------------------------------------------------------------------


@correction("muon_efficiency")
def muon_efficiency(
    df: DataFrame, ctx: Context, coll: str = "muons", pt: str = "pt", components: Sequence[str] = ("id", "mva"), max_pt: float = 1000.0, out: str = "muon_weight", index: str | None = None
) -> DataFrame:
    """Efficiency scale factors: product over good muons above 15, 1 unless one
    exceeds 20. Up and down shift one component at a time, in quadrature, lower
    end at 0. One component acts as a single combined table. With ``index`` the
    weight is that of one indexed muon."""
    t = ctx.tables["muon_sf"]

    def field_of(c: str, v: str) -> str:
        return f"sf_{c}" if v == "nominal" else f"sf_{c}_{v}"

    part = t.fixed(components[0], "nominal")
    df = add_fields(df, coll, {"_sf_cell": lambda o: part.cell(V.clamp(o["eta"], -2.39, 2.39), V.clamp(o[pt], 15.1, max_pt))})
    values = {}
    for c in components:
        for v in ("nominal", "up", "down"):
            values[field_of(c, v)] = lambda o, c=c, v=v: t.fixed(c, v).value(o["_sf_cell"])
    df = add_fields(df, coll, values)

    # products over the components of a cell, nominal and one component shifted
    tables = {(c, v): t.fixed(c, v).values for c in components for v in ("nominal", "up", "down")}
    kinds = [None] + [(c, d) for c in components for d in ("up", "down")]
    pick = lambda c, kind: tables[c, kind[1] if kind and kind[0] == c else "nominal"]
    at = side_by_side([[math.prod(cell) for cell in zip(*(pick(c, kind) for c in components))] for kind in kinds])
    factors = lambda o: at(o["_sf_cell"])
    ones = F.array_repeat(F.lit(1.0), len(kinds))
    if index is not None:
        weights = F.coalesce(factors(F.get(F.col(coll), F.col(index))), ones)
    else:
        lead = F.exists(F.col(coll), lambda o: o["good"] & (o[pt] > 20.0))
        chosen = F.filter(coll, lambda o: o["good"] & (o[pt] > 15.0))
        weights = F.when(lead, V.products(chosen, factors, len(kinds))).otherwise(ones)
    df = df.withColumn("_weights", weights)
    shifted = {(c, d): F.get("_weights", F.lit(1 + 2 * i + k)) for i, c in enumerate(components) for k, d in enumerate(("up", "down"))}
    nominal = F.get("_weights", F.lit(0))
    if len(components) == 1:
        only = components[0]
        return add_columns(df, {out: nominal, f"{out}_up": shifted[only, "up"], f"{out}_down": shifted[only, "down"]}).drop("_weights")
    up = F.sqrt(sum((F.pow(shifted[c, "up"] - nominal, 2) for c in components), F.lit(0.0)))
    down = F.sqrt(sum((F.pow(nominal - shifted[c, "down"], 2) for c in components), F.lit(0.0)))
    return add_columns(df, {out: nominal, f"{out}_up": nominal + up, f"{out}_down": F.greatest(F.lit(0.0), nominal - down)}).drop("_weights")


@correction("trigger")
def trigger(df: DataFrame, ctx: Context, coll: str = "muons", pt: str = "pt", lead: str = "lead_idx", sublead: str = "sublead_idx", tags: Sequence[str] = (), out: str = "trigger_weight") -> DataFrame:
    """Trigger scale factor by the leading pt (one axis) or both (two axes);
    1 for an invalid index. The table is the first available of the era tags,
    unity when there is none."""
    table = next((ctx.tables[f"trigger_{t}"] for t in tags if f"trigger_{t}" in ctx.tables), None)
    names = {"nominal": out, "up": f"{out}_up", "down": f"{out}_down"}
    if table is None:
        return add_columns(df, {c: F.lit(1.0) for c in names.values()})
    p1 = F.get(F.col(coll), F.col(lead))[pt]
    p2 = F.get(F.col(coll), F.col(sublead))[pt]
    at = [F.greatest(p1, F.lit(0.0))] + ([F.greatest(p2, F.lit(0.0))] if len(table.axes) == 2 else [])
    valid = p1.isNotNull() & (p2.isNotNull() if len(at) == 2 else F.lit(True))
    return add_columns(df, {c: F.when(valid, table.at(v, *at)).otherwise(F.lit(1.0)) for v, c in names.items()})


@correction("muon_scale")
def muon_scale(df: DataFrame, ctx: Context, coll: str = "muons") -> DataFrame:
    """Momentum scale 1 / (m / pt + q a) inside the calibrated range, and its
    statistical variation."""
    t = ctx.tables["muon_scale"]  # categories: a, m, stat_a, stat_m, rho

    def inside(o: Column) -> Column:
        return (F.abs(o["eta"]) <= 2.4) & o["pt"].between(26.0, 200.0)

    df = add_fields(df, coll, {"_scale_cell": lambda o: t.fixed("m").cell(o["eta"], o["phi"])})

    def scaled(o: Column) -> Column:
        m, a = (t.fixed(n).value(o["_scale_cell"]) for n in ("m", "a"))
        return F.when(inside(o), 1.0 / (m / o["pt"] + o["charge"] * a)).otherwise(o["pt"])

    return add_fields(df, coll, {"pt_scaled": scaled})


@correction("muon_smear")
def muon_smear(df: DataFrame, ctx: Context, coll: str = "muons", key: Sequence[str] = ("event", "block")) -> DataFrame:
    """Momentum smear pt (1 + k sigma(pt) r). sigma is a polynomial floored at
    0, k the excess of the resolution in data, r a quantile looked up for a
    uniform number drawn from event, block and angle. Results outside 0.1..2
    times the input fall back to it."""
    poly, kt, quant, scale_t = (ctx.tables[n] for n in ("smear_sigma", "smear_k", "smear_quantile", "muon_scale"))
    cols = [F.col(k) for k in key]
    df = add_fields(
        df,
        coll,
        {
            "_scale_cell": lambda o: scale_t.fixed("m").cell(o["eta"], o["phi"]),
            "_r": lambda o: quant.at(F.abs(o["eta"]), keyed_uniform(*cols, F.floor(o["phi"] * 100 + 0.5), seed="r")),
            "_sigma": lambda o: F.greatest(
                F.lit(0.0),
                poly.at("p0", F.abs(o["eta"])) + poly.at("p1", F.abs(o["eta"])) * o["pt_scaled"] + poly.at("p2", F.abs(o["eta"])) * o["pt_scaled"] * o["pt_scaled"],
            ),
            "_k": lambda o: F.sqrt(
                F.greatest(F.lit(0.0), F.pow(kt.at("data", F.abs(o["eta"])), 2) - F.pow(kt.at("mc", F.abs(o["eta"])), 2))
            ),
        },
    )

    def inside(o: Column) -> Column:
        return (F.abs(o["eta"]) <= 2.4) & o["pt_scaled"].between(26.0, 200.0)

    def guarded(value: Column, base: Column) -> Column:
        def check(v: Column) -> Column:
            q = v / base
            return F.when(F.isnan(v) | (q > 2.0) | (q < 0.1) | (v < 0), base).otherwise(v)

        return V.bind(value, check)

    def smeared(o: Column) -> Column:
        value = o["pt_scaled"] * (1.0 + o["_k"] * o["_sigma"] * o["_r"])
        return F.when(inside(o), guarded(value, o["pt_scaled"])).otherwise(o["pt_scaled"])

    df = add_fields(df, coll, {"pt_corr": smeared})

    def resolution(sign: float) -> Callable[[Column], Column]:
        def one(o: Column) -> Column:
            pull = (o["pt_corr"] / o["pt_scaled"] - 1.0) / F.nullif(o["_k"], F.lit(0.0))
            value = o["pt_scaled"] * (1.0 + (o["_k"] + sign * kt.at("unc", F.abs(o["eta"]))) * pull)
            ok = (F.abs(o["eta"]) <= 2.4) & (o["_k"] > 0)
            return F.when(ok, guarded(value, o["pt_scaled"])).otherwise(o["pt_corr"])

        return one

    def statistical(sign: float) -> Callable[[Column], Column]:
        def one(o: Column) -> Column:
            p = o["pt_corr"]
            sm, sa, rho = (scale_t.fixed(n).value(o["_scale_cell"]) for n in ("stat_m", "stat_a", "rho"))
            unc = p * p * F.sqrt(F.greatest(F.lit(0.0), sm * sm / (p * p) + sa * sa + 2.0 * o["charge"] * rho * sm / p * sa))
            return F.when(F.abs(o["eta"]) <= 2.4, p + sign * unc).otherwise(p)

        return one

    return add_fields(
        df,
        coll,
        {
            "pt_scale_up": statistical(1.0),
            "pt_scale_down": statistical(-1.0),
            "pt_reso_up": resolution(1.0),
            "pt_reso_down": resolution(-1.0),
        },
    )


@correction("prescale")
def prescale(df: DataFrame, ctx: Context, run: str = "run", block: str = "block", paths: Sequence[str] = ()) -> DataFrame:
    """Prescale weight per path from interval tables; 0 outside all ranges."""
    return interval_value(df, run, block, {f"prescale_{p}": ctx.frames[f"prescale_{p}"] for p in paths})


# --- overlap between simulated samples -------------------------------------------


@correction("overlap")
def overlap(
    df: DataFrame,
    ctx: Context,
    part: str = "gen",
    jets: str = "genjets",
    rule: str = "v3",
    leptons: Callable[[Column], Column] | None = None,
    enriched: str = "TTBB",
    inclusive: str = "TTBAR",
) -> DataFrame:
    """Remove the overlap of two samples that both contain extra b jets.

    Terminal b hadrons get the origin of their ancestry, generator jets the
    hadron nearest to them (dR < 0.4): -1 not a fiducial b jet, -2 no hadron,
    -13 too close to a selected lepton (rule v3). The enriched sample keeps
    events with an additional fiducial b jet, the inclusive one those without;
    other datasets pass unchanged. Rule v2 has no lepton masking and drops the
    fiducial pt cut to none; rule v1 keeps events with fewer than two additional
    jets whatever the sample.
    """
    name = ctx.dataset.upper()
    is_enriched = enriched.upper() in name
    is_inclusive = inclusive.upper() in name and not is_enriched
    if rule != "v1" and not (is_enriched or is_inclusive):
        return df
    soft, depth = (-2, 10) if rule == "v1" else (1, 100)
    keep = F.transform(F.col(part), lambda p: V.has_bit(p["flags"], 13)) if rule == "v1" else None
    origin = V.terminal_sources(F.col(f"{part}.pdg"), F.col(f"{part}.mother"), depth, soft, keep)
    df = df.withColumn("_origin", origin)
    hadrons = F.zip_with(
        F.col(part), "_origin", lambda p, s: F.struct(p["eta"].alias("eta"), p["phi"].alias("phi"), s.alias("source"))
    )
    df = df.withColumn("_hadrons", hadrons)

    def fiducial(j: Column) -> Column:
        flavour = j["hadron_flavour"] == 5
        return flavour if rule == "v1" else flavour & (j["pt"] > 20.0) & (F.abs(j["eta"]) < 2.5)

    near = V.nearest(
        F.col(jets),
        F.col("_hadrons"),
        0.4,
        lambda h: h["source"] != 0,
        lambda j, h: folded_delta_r(j["eta"], j["phi"], h["eta"], h["phi"]),
        missing=-1 if rule == "v1" else -2,
    )
    df = df.withColumn("_near", near)
    masked = None
    if rule == "v3" and leptons is not None:
        df = df.withColumn("_leptons", F.filter(F.col(part), leptons))
        masked = F.transform(
            F.col(jets),
            lambda j: F.exists(F.col("_leptons"), lambda m: folded_delta_r(j["eta"], j["phi"], m["eta"], m["phi"]) < 0.4),
        )
        df = df.withColumn("_masked", masked)

    def source(j: Column, i: Column) -> Column:
        hit = V.follow(F.get("_near", i), F.col("_origin"))
        if masked is not None:
            hit = F.when(F.get("_masked", i), -13).otherwise(hit)
        return F.when(fiducial(j), hit).otherwise(F.lit(-1)).cast("int")

    df = settle(df.withColumn("genjet_source", F.transform(F.col(jets), source)), "genjet_source")
    src = F.col("genjet_source")
    if rule == "v1":
        extra = F.size(F.filter(src, lambda s: (s != 6) & (s != -1)))
        cols = {"n_additional": extra}
    else:
        cols = {
            "n_additional": F.size(F.filter(src, lambda s: (s != 6) & (s > 0))),
            "n_from_top": F.size(F.filter(src, lambda s: s == 6)),
            "n_masked": F.size(F.filter(src, lambda s: s == -13)),
        }
    df = df.withColumns(cols).drop("_origin", "_hadrons", "_near", "_leptons", "_masked")
    n = F.col("n_additional")
    if rule == "v1":
        return df.filter(n < 2)
    return df.filter(n >= 1) if is_enriched else df.filter(n == 0)


def muon_for_overlap(p: Column) -> Column:
    """Stable last-copy muon inside the acceptance."""
    return (
        (F.abs(p["pdg"]) == 13) & (p["status"] == 1) & V.has_bit(p["flags"], 13) & (p["pt"] >= 15.0) & (F.abs(p["eta"]) < 2.4)
    )


def lepton_for_overlap(p: Column) -> Column:
    """Stable last-copy electron or muon inside the acceptance."""
    muon = (F.abs(p["pdg"]) == 13) & (p["pt"] >= 25.0) & (F.abs(p["eta"]) < 2.4)
    electron = (F.abs(p["pdg"]) == 11) & (p["pt"] >= 30.0) & (F.abs(p["eta"]) < 2.5)
    return (muon | electron) & (p["status"] == 1) & V.has_bit(p["flags"], 13)


# --- trigger study ---------------------------------------------------------------


#: fixed values: muons of the trigger study. Smallest identification score and largest
#: tag of the matched jet, cuts of loose muons, and the tag of the jet that muons which
#: fail the score may have, by cone pt (linear between the two pt), and their isolation
PROMPT_SCORE, PROMPT_TAG = 0.64, 0.2480
LOOSE_MUON = {"cone_pt": 15.0, "eta": 2.4, "dxy": 0.05, "dz": 0.1, "sip3d": 8.0, "mini_iso": 0.4}
TAG_HIGH_PT, TAG_LOW_PT, TAG_AT_HIGH, TAG_SLOPE, TAG_AT_LOW = 45.0, 20.0, 0.0485, 0.00798, 0.2480
FAKEABLE_JET_ISO = 0.5
#: fixed values: distance up to which the matched jet counts, and its share in cone pt
CONE_DR, CONE_SHARE = 0.4, 0.9


def cone_pt(pt: Column, iso: Column, jet_pt: Column, jet_dr: Column, divide: bool = True) -> Column:
    """pt of the object or of its matched jet: 0.9 of the jet when close, else
    pt / (1 + iso) (or times)."""
    far = pt / (1.0 + iso) if divide else pt * (1.0 + iso)
    return F.when(jet_dr <= CONE_DR, CONE_SHARE * jet_pt).otherwise(far)


def loose_muon(o: Column) -> Column:
    """Cone pt, acceptance, impact parameters, identification, mini isolation."""
    cut = LOOSE_MUON
    near = (F.abs(o["dxy"]) < cut["dxy"]) & (F.abs(o["dz"]) < cut["dz"]) & (F.abs(o["sip3d"]) < cut["sip3d"])
    return (o["cone_pt"] > cut["cone_pt"]) & (F.abs(o["eta"]) < cut["eta"]) & near & o["medium_id"] & (o["mini_iso"] < cut["mini_iso"])


def fakeable_tag(o: Column, tuned: bool = False) -> Column:
    """The jet tag that a muon below the score may have."""
    if tuned:
        return o["jet_df_corr"] < PROMPT_TAG
    c = o["cone_pt"]
    falling = (TAG_HIGH_PT - c) * TAG_SLOPE + TAG_AT_HIGH
    return o["jet_df_corr"] < F.when(c >= TAG_HIGH_PT, TAG_AT_HIGH).when(c > TAG_LOW_PT, falling).otherwise(F.lit(TAG_AT_LOW))


@correction("trigger_study")
def trigger_study(
    df: DataFrame,
    ctx: Context,
    muons: str = "muons",
    jets: str = "jets",
    event_weight: str | None = "veto_weight",
    jet_good: Callable[[Column], Column] = lambda j: j["id_tight"] & (j["pt"] > 15.0),
    mva: Callable[[Column], Column] = lambda o: (o["mva"] >= PROMPT_SCORE) & (o["jet_df_corr"] < PROMPT_TAG),
    loose: Callable[[Column], Column] = loose_muon,
    fakeable: bool = False,
    tuned: bool = False,
    jet_pt: float = 30.0,
    jet_dr: float = 0.7,
) -> DataFrame:
    """Object chain of the trigger study: events of positive weight, muons linked to
    good jets, cone pt (from the mini isolation), corrected isolation (the matched jet,
    else the isolation ``pf_iso``), loose (and fakeable) muons, exactly one selected
    muon and a recoil jet away from it.

    A fakeable muon is loose and passes the score, or stays below it with a small tag of
    its jet (by cone pt, or one cut if ``tuned``) and ``jet_rel_iso`` below 0.5.
    """
    if event_weight is not None:
        df = df.filter(F.col(event_weight) > 0)
    df = df.withColumn("_jet_ok", V.mask(F.col(jets), jet_good))
    df = add_fields(df, muons, {"jet_link": lambda o: F.when(F.get("_jet_ok", o["jet_idx"]), o["jet_idx"]).otherwise(F.lit(-1))})

    def jet_of(o: Column) -> Column:
        return F.get(F.col(jets), o["jet_link"])

    df = add_fields(
        df,
        muons,
        {
            "jet_pt": lambda o: F.coalesce(jet_of(o)["pt"], F.lit(-999.0)),
            "jet_dr": lambda o: F.coalesce(V.delta_r(o["eta"], o["phi"], jet_of(o)["eta"], jet_of(o)["phi"]), F.lit(999.0)),
        },
    )
    df = add_fields(
        df,
        muons,
        {
            "rel_iso_corr": lambda o: F.when(o["jet_dr"] < CONE_DR, o["jet_pt"] / o["pt"] - 1.0).otherwise(o["pf_iso"]),
            "jet_df_corr": lambda o: F.when(o["jet_dr"] < CONE_DR, o["jet_df"]).otherwise(F.lit(0.0)),
        },
    )
    df = add_fields(df, muons, {"pass_mva": mva})
    df = add_fields(
        df, muons, {"cone_pt": lambda o: F.when(o["pass_mva"], o["pt"]).otherwise(cone_pt(o["pt"], o["mini_iso"], o["jet_pt"], o["jet_dr"]))}
    )
    df = add_fields(df, muons, {"is_loose": loose})
    if fakeable:

        def below(o: Column) -> Column:
            return (o["mva"] < PROMPT_SCORE) & fakeable_tag(o, tuned) & (o["jet_rel_iso"] < FAKEABLE_JET_ISO)

        df = add_fields(df, muons, {"is_fakeable": lambda o: o["is_loose"] & (o["pass_mva"] | below(o))})
    flag = "is_fakeable" if fakeable else "is_loose"
    df = settle(df, muons)
    df = df.withColumn("_sel", V.positions(V.mask(F.col(muons), lambda o: o[flag]))).filter(F.size("_sel") == 1)
    df = df.withColumn("lead_idx", F.get("_sel", F.lit(0))).withColumn("_lead", F.get(F.col(muons), F.col("lead_idx")))
    far = V.positions(
        V.mask(
            F.col(jets),
            lambda j: jet_good(j) & (j["pt"] > jet_pt) & (V.delta_r(j["eta"], j["phi"], F.col("_lead")["eta"], F.col("_lead")["phi"]) > jet_dr),
        )
    )
    df = df.withColumn("_far", far).filter(F.size("_far") > 0)
    return df.withColumns(
        {
            "n_iso_jet": F.size("_far"),
            "lead_jet_pt": F.get(F.col(jets), F.get("_far", F.lit(0)))["pt"],
            "lead_cone_pt": F.col("_lead")["cone_pt"],
            "lead_pt": F.col("_lead")["pt"],
            "lead_rel_iso": F.col("_lead")["rel_iso_corr"],
        }
    ).drop("_jet_ok", "_sel", "_lead", "_far")
