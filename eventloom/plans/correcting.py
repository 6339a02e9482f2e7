"""Correction chains on the objects of an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import vectors as V
from eventloom.operators.corrections import (
    SHAPE_FLAVOURS,
    ERA_THRESHOLDS,
    Context,
    apply_corrections,
    add_fields,
    identified,
    jet_identification,
    lepton_for_overlap,
    muon_for_overlap,
)
from eventloom.operators.lookup import BinnedTable, StoredTable
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, events, heads, nested, r, sql_dr, sql_folded

YEARS = list(range(1995, 2002))
ETAS = (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)
ABS_ETAS = (0.0, 0.8, 1.6, 2.5)
PHIS = (-3.2, -1.6, 0.0, 1.6, 3.2)
PTS = (0.0, 15.0, 30.0, 50.0, 75.0, 120.0)


def ramp(n: int, start: float, step: float, wave: int = 7) -> list[float]:
    """Table contents from a rule."""
    return [round(start + step * ((i * 3) % wave) + 0.000371 * (1 + i % 13), 6) for i in range(n)]


def binned(axes, start, step, categories=(), wave=7) -> BinnedTable:
    n = 1
    for _, k in categories:
        n *= len(k)
    for _, e in axes:
        n *= len(e) - 1
    return BinnedTable(axes, ramp(n, start, step, wave), categories)


L2 = binned([("eta", ETAS), ("pt", PTS)], 0.95, 0.02)
L2_PHI = binned([("eta", ETAS), ("phi", PHIS), ("pt", PTS)], 0.95, 0.02)
RESIDUAL = binned([("eta", ETAS), ("pt", PTS)], 0.98, 0.01, [("run", YEARS)], 5)
SOURCES = ["Absolute", "FlavorQCD", "HF"]
SCALE_SOURCES = binned([("eta", ETAS), ("pt", PTS)], 0.01, 0.005, [("source", SOURCES)], 11)
RESOLUTION = binned([("eta", ETAS), ("pt", PTS), ("rho", (0.0, 1.0, 2.0, 6.0))], 0.05, 0.02)
RESOLUTION_SF = binned([("eta", ETAS), ("pt", PTS)], 1.0, 0.03, [("variation", ["nom", "up", "down"])], 9)
VETO = BinnedTable([("eta", ETAS), ("phi", PHIS)], [100.0 if i % 6 == 2 else 0.0 for i in range(20)])
PILEUP = binned([("count", tuple(float(x) for x in range(0, 101, 10)))], 0.8, 0.1, [("variation", ["nominal", "up", "down"])])
WPS = {"L": 0.2, "M": 0.5, "T": 0.8}
TAG_SOURCES = ["jes", "statistic", "type3"]
TAG_SYSTS = ["central", "up", "down"] + [f"{d}_{s}" for s in TAG_SOURCES for d in ("up", "down")]
FLAVOURS = [0, 4, 5]
BTAG_SF = binned([("eta", ABS_ETAS), ("pt", PTS)], 0.9, 0.02, [("syst", TAG_SYSTS), ("wp", list(WPS)), ("flavour", FLAVOURS)], 11)
BTAG_EFF = binned([("pt", PTS)], 0.2, 0.08, [("wp", list(WPS)), ("flavour", FLAVOURS)], 9)
BTAG_EFF = BinnedTable([("eta", (0.0, 2.5)), ("pt", PTS)], BTAG_EFF.values, BTAG_EFF.categories)
SHAPE_SOURCES = ["cferr1", "hf", "lf"]
SHAPE_SYSTS = ["central"] + [f"{d}_{s}" for s in SHAPE_SOURCES for d in ("up", "down")]
BTAG_SHAPE = binned(
    [("eta", ABS_ETAS), ("pt", (0.0, 30.0, 60.0, 200.0)), ("score", (0.0, 0.3, 0.6, 1.1))], 0.9, 0.03, [("syst", SHAPE_SYSTS), ("flavour", FLAVOURS)], 8
)
MUON_SF = binned([("eta", ETAS), ("pt", PTS)], 0.95, 0.01, [("component", ["id", "mva"]), ("variation", ["nominal", "up", "down"])], 11)
TRIGGER_1D = binned([("pt", PTS)], 0.9, 0.03, [("variation", ["nominal", "up", "down"])])
TRIGGER_2D = binned([("pt1", PTS), ("pt2", PTS)], 0.9, 0.02, [("variation", ["nominal", "up", "down"])])
MUON_SCALE = BinnedTable(
    [("eta", (-2.5, 0.0, 2.5)), ("phi", (-3.2, 0.0, 3.2))],
    [0.0002, -0.0001, 0.0003, 0.0001, 1.001, 0.999, 1.002, 0.998, 0.0001, 0.0002, 0.0001, 0.0003, 0.001, 0.002, 0.001, 0.003, 0.1, -0.2, 0.3, 0.0],
    [("what", ["a", "m", "stat_a", "stat_m", "rho"])],
)
SMEAR_SIGMA = BinnedTable([("eta", (0.0, 1.2, 2.5))], [0.01, 0.02, 0.0001, 0.0002, -0.0000005, 0.000001], [("par", ["p0", "p1", "p2"])])
SMEAR_K = BinnedTable([("eta", (0.0, 1.2, 2.5))], [1.2, 1.0, 1.0, 1.1, 0.05, 0.04], [("what", ["data", "mc", "unc"])])
SMEAR_QUANTILE = BinnedTable(
    [("eta", (0.0, 1.2, 2.5)), ("u", tuple(i / 10 for i in range(11)))],
    [-1.6, -1.0, -0.7, -0.4, -0.1, 0.1, 0.4, 0.7, 1.0, 1.6, -1.8, -1.1, -0.8, -0.5, -0.1, 0.1, 0.5, 0.8, 1.1, 1.8],
)


def sql_at(t: BinnedTable, *inputs: str) -> str:
    """The table as a list literal with the cell number as index."""
    flat = "0"
    for i, (_, keys) in enumerate(t.categories):
        if inputs[i].startswith("="):
            no = str(list(keys).index(inputs[i][1:]))
        else:
            no = "CASE " + inputs[i] + " " + " ".join(f"WHEN {k if isinstance(k, int) else repr(k)} THEN {j}" for j, k in enumerate(keys)) + " END"
        flat = f"({flat} * {len(keys)} + {no})"
    for j, (_, edges) in enumerate(t.axes):
        x = inputs[len(t.categories) + j]
        steps = " + ".join([f"CASE WHEN {x} >= {e}::DOUBLE THEN 1 ELSE 0 END" for e in edges[1:-1]] or ["0"])
        flat = f"({flat} * {len(edges) - 1} + {steps})"
    return "CAST(([" + ", ".join(f"{v!r}::DOUBLE" for v in t.values) + f"])[1 + {flat}] AS DOUBLE)"


FLAVOUR = {"A": 0, "N": 4, "R": 5}
SQL_FLAVOUR = "CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 5 END"


def jets(spark, sf, *more, head=()):
    """Events with the collection ``jets``; ``raw`` and ``flavour`` included."""
    fields = ["pt", "eta", "phi", "mass", "score", "rel", "flag", "part", "supp", "charge"]
    ev = events(spark, sf, fields, head).filter(F.size("obj") > 0)
    flavour = lambda o: F.when(o["flag"] == "A", 0).when(o["flag"] == "N", 4).otherwise(5)
    made = F.transform("obj", lambda o, i: o.withField("raw", o["rel"]).withField("flavour", flavour(o)).withField("gen_idx", i - 1))
    return ev.withColumn("jets", made).drop("obj")


def per_jet(df, *fields, coll="jets", head=()):
    out = df.select("k", *head, F.posexplode_outer(coll).alias("i", "j"))
    return out.select("k", *head, "i", *[F.col(f"j.{f}").alias(f) for f in fields])


SQL_JET = f"WITH {SQL_OBJ}, j0 AS (SELECT *, rel AS raw, {SQL_FLAVOUR} AS flavour FROM obj)"
SQL_L2 = f"""{SQL_JET}, j1 AS (SELECT *, pt * (1 - raw) AS rp FROM j0), j2 AS (SELECT *, {sql_at(L2, 'eta', 'rp')} AS l2 FROM j1),
jet AS (SELECT *, rp * l2 AS pt_jec, mass * (1 - raw) * l2 AS mass_jec FROM j2)"""


@query(f"{SQL_L2} SELECT k, i, round(l2, 9) AS l2, round(pt_jec, 6) AS pt_jec, round(mass_jec, 9) AS mass_jec FROM jet")
def jet_energy_simulation(spark, sf):
    """Stored calibration undone, level-2 factor applied to pt and mass."""
    df = apply_corrections(jets(spark, sf), ["jet_scale_mc"], Context(tables={"l2": L2}))
    out = per_jet(df, "l2", "pt_jec", "mass_jec")
    return out.select("k", "i", r("l2", 9).alias("l2"), r("pt_jec").alias("pt_jec"), r("mass_jec", 9).alias("mass_jec"))


@query(
    f"""{SQL_JET}, {SQL_EV}, j1 AS (SELECT j0.*, run, pt * (1 - raw) AS rp FROM j0 JOIN ev USING (k)), j2 AS (SELECT *, {sql_at(L2_PHI, 'eta', 'phi', 'rp')} AS l2 FROM j1),
j3 AS (SELECT *, {sql_at(RESIDUAL, 'run', 'eta', '(rp * l2)')} AS residual FROM j2)
SELECT k, i, round(rp * l2 * residual, 8) AS pt_jec, round(mass * (1 - raw) * l2 * residual, 8) AS mass_jec FROM j3"""
)
def jet_energy_data(spark, sf):
    """Level 2 with angle, then the residual by run, eta and corrected pt."""
    ctx = Context(tables={"l2": L2_PHI, "residual": RESIDUAL}, options={"jet_scale_data": {"with_phi": True}})
    df = apply_corrections(jets(spark, sf, head=["run"]), ["jet_scale_data"], ctx)
    return per_jet(df, "pt_jec", "mass_jec").select("k", "i", r("pt_jec", 8).alias("pt_jec"), r("mass_jec", 8).alias("mass_jec"))


#: a residual of more than a million cells: run, fine eta and fine pt
FINE_ETA, FINE_PT = tuple(-2.4 + k * 0.08 for k in range(61)), tuple(k * 0.05 for k in range(2601))


def _fine_residual(spark) -> StoredTable:
    """Values follow from the number of the cell by a rule."""
    cells = spark.range(len(YEARS) * 60 * 2600).select(F.col("id").alias("cell"), (F.lit(0.9) + (F.col("id") % 1009) / F.lit(9973.0)).alias("value"))
    return StoredTable([("eta", FINE_ETA), ("pt", FINE_PT)], cells, [("run", YEARS)])


def _sql_fine(x: str, edges: str) -> str:
    return f"len([e FOR e IN {edges} IF e <= {x}])"


@query(
    f"""{SQL_JET}, {SQL_EV}, j1 AS (SELECT j0.*, run, pt * (1 - raw) AS rp FROM j0 JOIN ev USING (k)), j2 AS (SELECT *, {sql_at(L2, 'eta', 'rp')} AS l2 FROM j1),
j3 AS (SELECT *, ((CASE run {' '.join(f'WHEN {y} THEN {i}' for i, y in enumerate(YEARS))} END) * 60 + {_sql_fine('eta', '[-2.4::DOUBLE + q * 0.08::DOUBLE FOR q IN range(1, 60)]')}) * 2600 + {_sql_fine('(rp * l2)', '[q * 0.05::DOUBLE FOR q IN range(1, 2600)]')} AS cell FROM j2),
j4 AS (SELECT *, 0.9::DOUBLE + (cell % 1009) / 9973.0::DOUBLE AS residual FROM j3)
SELECT k, i, round(residual, 9) AS residual, round(rp * l2 * residual, 8) AS pt_jec, round(mass * (1 - raw) * l2 * residual, 8) AS mass_jec FROM j4"""
)
def jet_energy_fine(spark, sf):
    """A residual table of over a million cells, joined while the jets are apart once."""
    ctx = Context(tables={"l2": L2, "residual": _fine_residual(spark)}, key=["k"])
    df = apply_corrections(jets(spark, sf, head=["run"]), ["jet_scale_data"], ctx)
    out = per_jet(df, "residual", "pt_jec", "mass_jec")
    return out.select("k", "i", r("residual", 9).alias("residual"), r("pt_jec", 8).alias("pt_jec"), r("mass_jec", 8).alias("mass_jec"))


@query(SQL_L2 + " SELECT k, i, " + ", ".join(f"round({sql_at(SCALE_SOURCES, '=' + s, 'eta', 'pt_jec')}, 9) AS \"{s}\"" for s in SOURCES) + " FROM jet")
def jet_energy_sources(spark, sf):
    """Relative uncertainty of every source as an own field."""
    ctx = Context(tables={"l2": L2, "scale_sources": SCALE_SOURCES}, options={"jet_scale_sources": {"sources": SOURCES}})
    df = apply_corrections(jets(spark, sf), ["jet_scale_mc", "jet_scale_sources"], ctx)
    return per_jet(df, *SOURCES).select("k", "i", *[r(s, 9).alias(s) for s in SOURCES])


def _sql_u(seed: str, *keys: str) -> str:
    cast = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {cast})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _sql_smear(variation: str) -> str:
    s = sql_at(RESOLUTION_SF, "=" + variation, "eta", "pt_jec")
    return f"""greatest(0.0::DOUBLE, CASE WHEN partner IS NOT NULL THEN 1 + ({s} - 1) * (pt_jec - partner) / pt_jec
  ELSE 1 + draw * reso * sqrt(greatest({s} * {s} - 1, 0.0::DOUBLE)) END)"""


@query(
    f"""{SQL_L2}, {SQL_EV}, r0 AS (SELECT jet.*, w, {sql_at(RESOLUTION, 'eta', 'pt_jec', 'w')} AS reso,
  sqrt(-2.0 * ln(1.0 - {_sql_u('u1', 'k', 'i')})) * cos(6.283185307179586::DOUBLE * {_sql_u('u2', 'k', 'i')}) AS draw FROM jet JOIN ev USING (k)),
r1 AS (SELECT a.*, CASE WHEN power({sql_dr('g', 'a')}, 2) < 0.04 AND abs(g.pt - a.pt_jec) < 3 * a.reso * a.pt_jec THEN g.pt END AS partner FROM r0 a LEFT JOIN j0 g ON a.k = g.k AND g.i = a.i - 1)
SELECT k, i, round({_sql_smear('nom')}, 6) AS jer, round({_sql_smear('up')}, 6) AS jer_up, round({_sql_smear('down')}, 6) AS jer_down FROM r1"""
)
def jet_resolution(spark, sf):
    """Hybrid smearing with a keyed draw, nominal, up and down."""
    ctx = Context(
        tables={"l2": L2, "resolution": RESOLUTION, "resolution_sf": RESOLUTION_SF},
        options={"jet_smear": {"gen": "jets", "rho": "w", "key": ["k"]}},
    )
    df = apply_corrections(jets(spark, sf, head=["w"]), ["jet_scale_mc", "jet_smear"], ctx)
    return per_jet(df, "jer", "jer_up", "jer_down").select("k", "i", *[r(c).alias(c) for c in ("jer", "jer_up", "jer_down")])


def _veto(spark, sf, leptons, **more):
    df = apply_corrections(jets(spark, sf), ["jet_scale_mc"], Context(tables={"l2": L2}))
    fractions = {
        "jetId": lambda o: o["part"],
        "neHEF": lambda o: o["score"],
        "neEmEF": lambda o: o["mass"] / 8.0,
        "chEmEF": lambda o: o["rel"] * 8.0,
        "muEF": lambda o: o["score"] * 0.95,
    }
    df = add_fields(df, "jets", fractions)
    df = df.withColumns(
        {
            "muons": F.filter("jets", lambda o: (o["charge"] > 0) & (o["score"] > 0.6)),
            "electrons": F.filter("jets", lambda o: (o["charge"] < 0) & (o["score"] > 0.8)),
        }
    )
    opts = {
        "leptons": leptons,
        "shifts": {"up": lambda o: o["pt_jec"] * 1.2, "down": lambda o: o["pt_jec"] * 0.8},
        **more,
    }
    return apply_corrections(df, ["jet_veto"], Context(tables={"veto_map": VETO}, options={"jet_veto": opts}))


SQL_VETO = f"""{SQL_L2}, v AS (SELECT *, {sql_at(VETO, 'eta', 'phi')} = 0 AS pass_veto,
  (part >> 1) & 1 = 1 AND (abs(eta) <= 2.7 OR (abs(eta) <= 3 AND score < 0.99) OR (abs(eta) > 3 AND mass / 8 < 0.4)) AND (abs(eta) > 2.7 OR (score * 0.95 < 0.8 AND rel * 8 < 0.8)) AS id_tight,
  mass / 8 + rel * 8 < 0.9 AS loose FROM jet),
w0 AS (SELECT k, max(CASE WHEN pt_jec > 15 AND id_tight AND loose AND NOT pass_veto THEN 1 ELSE 0 END) AS b0,
  max(CASE WHEN pt_jec * 1.2 > 15 AND id_tight AND loose AND NOT pass_veto THEN 1 ELSE 0 END) AS b1, max(CASE WHEN pt_jec * 0.8 > 15 AND id_tight AND loose AND NOT pass_veto THEN 1 ELSE 0 END) AS b2 FROM v GROUP BY k)"""


def _sql_good(refs: str) -> str:
    return f"""d AS (SELECT v.k, v.i, min({sql_dr('m', 'v')}) AS near FROM v LEFT JOIN v m ON v.k = m.k AND ({refs}) GROUP BY 1, 2),
g AS (SELECT v.*, pt_jec > 30 AND abs(eta) < 2.5 AND raw < 0.9 AND id_tight AND least(coalesce(near, 999), 999) > 0.4 AS good FROM v JOIN d USING (k, i))"""


@query(
    f"""{SQL_VETO}, {_sql_good('m.charge > 0 AND m.score > 0.6')}
SELECT k, CASE WHEN b0 = 1 THEN 0.0::DOUBLE ELSE 1 END AS veto_weight, CASE WHEN b1 = 1 THEN 0.0::DOUBLE ELSE 1 END AS veto_weight_up, CASE WHEN b2 = 1 THEN 0.0::DOUBLE ELSE 1 END AS veto_weight_down,
  CAST(count(*) FILTER (good) AS INTEGER) AS n_good FROM g JOIN w0 USING (k) GROUP BY k, b0, b1, b2"""
)
def jet_veto_map(spark, sf):
    """Veto flags, event weight with shifted versions, good jets away from muons."""
    df = _veto(spark, sf, ("muons",))
    n = V.count_where(F.col("jets"), lambda o: o["good"]).alias("n_good")
    return df.select("k", "veto_weight", "veto_weight_up", "veto_weight_down", n)


@query(
    f"""{SQL_VETO}, {_sql_good('(m.charge > 0 AND m.score > 0.6) OR (m.charge < 0 AND m.score > 0.8)')}
SELECT k, CAST(count(*) FILTER (good) AS INTEGER) AS n_good FROM g GROUP BY k"""
)
def jet_veto_two_leptons(spark, sf):
    """The same with electrons and muons as overlap references."""
    df = _veto(spark, sf, ("muons", "electrons"))
    return df.select("k", V.count_where(F.col("jets"), lambda o: o["good"]).alias("n_good"))


@query(
    f"""{SQL_JET}, x AS (SELECT *, abs(eta) AS a, score AS ne, mass / 5 AS em, rel * 10 AS ch, CAST(part % 4 AS INTEGER) AS cm, CAST(supp % 3 AS INTEGER) AS nm, score * 0.95 AS mu, rel * 12 AS cem FROM j0)
SELECT k, i, (a <= 2.6 AND ne < 0.99 AND em < 0.9 AND cm + nm > 1 AND ch > 0.01 AND cm > 0) OR (a > 2.6 AND a <= 2.7 AND ne < 0.9 AND em < 0.99) OR (a > 2.7 AND a <= 3 AND ne < 0.99) OR (a > 3 AND nm >= 2 AND em < 0.4) AS by_fractions,
  (part >> 1) & 1 = 1 AND (a <= 2.7 OR (a <= 3 AND ne < 0.99) OR (a > 3 AND em < 0.4)) AS by_bits,
  (part >> 1) & 1 = 1 AND (a <= 2.7 OR (a <= 3 AND ne < 0.99) OR (a > 3 AND em < 0.4)) AND (a > 2.7 OR (mu < 0.8 AND cem < 0.8)) AS no_lepton FROM x"""
)
def jet_identification_flags(spark, sf):
    """Identification from energy fractions and from the stored bit."""
    j = F.transform(
        "jets",
        lambda o: F.struct(
            o["eta"].alias("eta"),
            o["score"].alias("neHEF"),
            (o["mass"] / 5.0).alias("neEmEF"),
            (o["rel"] * 10.0).alias("chHEF"),
            (o["part"] % 4).alias("chMult"),
            (o["supp"] % 3).alias("neMult"),
            o["part"].alias("jetId"),
            (o["score"] * 0.95).alias("muEF"),
            (o["rel"] * 12.0).alias("chEmEF"),
        ),
    )
    df = jets(spark, sf).select("k", F.posexplode_outer(j).alias("i", "o"))
    o = F.col("o")
    return df.select("k", "i", jet_identification(o, "fractions").alias("by_fractions"), jet_identification(o, "bits").alias("by_bits"), identified("bits")(o).alias("no_lepton"))


@query(
    f"""WITH {SQL_EV}, p AS (SELECT k, least(greatest(w * 30, 0.0), 99.0) AS n FROM ev)
SELECT k, round({sql_at(PILEUP, '=nominal', 'n')}, 9) AS pu_weight, round({sql_at(PILEUP, '=up', 'n')}, 9) AS pu_weight_up, round({sql_at(PILEUP, '=down', 'n')}, 9) AS pu_weight_down FROM p"""
)
def pileup_weight(spark, sf):
    """Pile-up weight by the clamped count."""
    ev = heads(spark, sf, "w").withColumn("n_true", F.col("w") * 30.0)
    out = apply_corrections(ev, ["pileup"], Context(tables={"pileup": PILEUP}))
    return out.select("k", *[r(c, 9).alias(c) for c in ("pu_weight", "pu_weight_up", "pu_weight_down")])


def _good_jets(spark, sf):
    df = apply_corrections(jets(spark, sf), ["jet_scale_mc"], Context(tables={"l2": L2}))
    good = lambda o: o.withField("good", (o["pt_jec"] > 20) & (F.abs(o["eta"]) < 2.2)).withField("id_tight", o["mass"] < 4.5)
    return df.withColumn("jets", F.transform("jets", good))


def _sql_where(lo: float, hi: float) -> tuple[str, str]:
    return "abs(least(greatest(eta, -2.49), 2.49))", f"least(greatest(pt_jec, {lo}), {hi})"


def _sql_sf(syst: str, wp: str) -> str:
    a, p = _sql_where(20.1, 999.9)
    return f"(CASE WHEN flavour = 0 THEN 1.0::DOUBLE ELSE {sql_at(BTAG_SF, '=' + syst, '=' + wp, 'flavour', a, p)} END)"


def _sql_factor(syst: str, wp: str) -> str:
    a, p = _sql_where(20.1, 999.9)
    eff = sql_at(BTAG_EFF, "=" + wp, "flavour", a, p)
    return f"(CASE WHEN NOT good THEN 1.0::DOUBLE WHEN score > {WPS[wp]} THEN {_sql_sf(syst, wp)} WHEN {eff} < 1 THEN (1 - {_sql_sf(syst, wp)} * {eff}) / (1 - {eff}) ELSE 1.0::DOUBLE END)"


SQL_GOOD = SQL_L2 + ", gj AS (SELECT *, pt_jec > 20 AND abs(eta) < 2.2 AS good FROM jet)"
_TAG_COLUMNS = [(f"btag_weight_{wp}{s}", c, wp) for wp in WPS for s, c in (("", "central"), ("_up", "up"), ("_down", "down"))]
_TAG_COLUMNS += [(f"btag_weight_{s}_{d}", f"{d}_{s}", "M") for s in TAG_SOURCES for d in ("up", "down")]
_VARIED = [c for c, _, _ in _TAG_COLUMNS[9:]]


@query(
    f"""{SQL_GOOD}, p AS (SELECT k, {", ".join(f"product({_sql_factor(s, wp)}) AS {c}" for c, s, wp in _TAG_COLUMNS)} FROM gj GROUP BY k)
SELECT k, {", ".join(f"round({c}, 6) AS {c}" for c, _, _ in _TAG_COLUMNS)},
  round(btag_weight_M + sqrt({" + ".join(f"power(greatest(0, {c} - btag_weight_M), 2)" for c in _VARIED)}), 6) AS total_up,
  round(greatest(0, btag_weight_M - sqrt({" + ".join(f"power(greatest(0, btag_weight_M - {c}), 2)" for c in _VARIED)})), 6) AS total_down FROM p"""
)
def btag_working_points(spark, sf):
    """Fixed working points, source variations and their quadrature totals."""
    opts = {"points": WPS, "sources": TAG_SOURCES}
    df = apply_corrections(_good_jets(spark, sf), ["btag_working_point"], Context(tables={"btag_sf": BTAG_SF, "btag_eff": BTAG_EFF}, options={"btag_working_point": opts}))
    return df.select(
        "k", *[r(c).alias(c) for c, _, _ in _TAG_COLUMNS], r("btag_weight_total_up").alias("total_up"), r("btag_weight_total_down").alias("total_down")
    )


def _sql_shape(syst: str, flavours=None) -> str:
    a, p = _sql_where(20.1, 199.9)
    s = "least(greatest(score, 0.0001), 1.0999)"
    value = sql_at(BTAG_SHAPE, "=" + syst, "flavour", a, p, s)
    if flavours:
        value = f"(CASE WHEN flavour IN ({', '.join(map(str, flavours))}) THEN {value} ELSE {sql_at(BTAG_SHAPE, '=central', 'flavour', a, p, s)} END)"
    return f"(CASE WHEN good AND abs(eta) <= 2.5 AND mass < 4.5 THEN {value} ELSE 1.0::DOUBLE END)"


@query(
    f"""{SQL_GOOD} SELECT k, round(product({_sql_shape('central')}), 6) AS btag_shape, round(product({_sql_shape('up_cferr1', [4])}), 6) AS btag_shape_cferr1_up,
  round(product({_sql_shape('down_cferr1', [4])}), 6) AS btag_shape_cferr1_down, round(product({_sql_shape('up_hf', [0, 5])}), 6) AS btag_shape_hf_up, round(product({_sql_shape('down_hf', [0, 5])}), 6) AS btag_shape_hf_down FROM gj GROUP BY k"""
)
def btag_shapes(spark, sf):
    """Shape weights; a source changes only jets of its flavours."""
    opts = {"sources": ["cferr1", "hf"]}
    df = apply_corrections(_good_jets(spark, sf), ["btag_shape"], Context(tables={"btag_shape": BTAG_SHAPE}, options={"btag_shape": opts}))
    return df.select("k", *[r(c).alias(c) for c in df.columns if c.startswith("btag_shape")])


#: thirteen sources of the working points and all sources of the shapes
MANY_TAG_SOURCES = [f"tag{n}" for n in range(1, 14)]
MANY_TAG_SF = binned(
    [("eta", ABS_ETAS), ("pt", PTS)], 0.9, 0.02,
    [("syst", ["central", "up", "down"] + [f"{d}_{s}" for s in MANY_TAG_SOURCES for d in ("up", "down")]), ("wp", list(WPS)), ("flavour", FLAVOURS)], 11,
)
_MANY_COLUMNS = _TAG_COLUMNS[:9] + [(f"btag_weight_{s}_{d}", f"{d}_{s}", "M") for s in MANY_TAG_SOURCES for d in ("up", "down")]
_MANY_VARIED = [c for c, _, _ in _MANY_COLUMNS[9:]]
ALL_SHAPES = list(SHAPE_FLAVOURS)
MANY_SHAPE = binned(
    [("eta", ABS_ETAS), ("pt", (0.0, 30.0, 60.0, 200.0)), ("score", (0.0, 0.3, 0.6, 1.1))], 0.9, 0.03,
    [("syst", ["central"] + [f"{d}_{s}" for s in ALL_SHAPES for d in ("up", "down")]), ("flavour", FLAVOURS)], 8,
)


def _sql_many(syst: str, wp: str) -> str:
    """As _sql_factor with the scale factor and efficiency bound as columns."""
    return f"(CASE WHEN NOT good THEN 1.0::DOUBLE WHEN score > {WPS[wp]} THEN sf_{syst}_{wp} WHEN eff_{wp} < 1 THEN (1 - sf_{syst}_{wp} * eff_{wp}) / (1 - eff_{wp}) ELSE 1.0::DOUBLE END)"


def _sql_many_bound() -> str:
    a, p = _sql_where(20.1, 999.9)
    sf = {f"sf_{s}_{wp}": f"CASE WHEN flavour = 0 THEN 1.0::DOUBLE ELSE {sql_at(MANY_TAG_SF, '=' + s, '=' + wp, 'flavour', a, p)} END" for _, s, wp in _MANY_COLUMNS}
    eff = {f"eff_{wp}": sql_at(BTAG_EFF, "=" + wp, "flavour", a, p) for wp in WPS}
    return ", ".join(f"{x} AS {n}" for n, x in (sf | eff).items())


@query(
    f"""{SQL_GOOD}, bound AS (SELECT *, {_sql_many_bound()} FROM gj), p AS (SELECT k, {", ".join(f"product({_sql_many(s, wp)}) AS {c}" for c, s, wp in _MANY_COLUMNS)} FROM bound GROUP BY k)
SELECT k, {", ".join(f"round({c}, 6) AS {c}" for c, _, _ in _MANY_COLUMNS)},
  round(btag_weight_M + sqrt({" + ".join(f"power(greatest(0, {c} - btag_weight_M), 2)" for c in _MANY_VARIED)}), 6) AS total_up,
  round(greatest(0, btag_weight_M - sqrt({" + ".join(f"power(greatest(0, btag_weight_M - {c}), 2)" for c in _MANY_VARIED)})), 6) AS total_down FROM p"""
)
def btag_thirteen_sources(spark, sf):
    """Working points with thirteen sources: 35 products in one walk over the jets."""
    opts = {"points": WPS, "sources": MANY_TAG_SOURCES}
    df = apply_corrections(_good_jets(spark, sf), ["btag_working_point"], Context(tables={"btag_sf": MANY_TAG_SF, "btag_eff": BTAG_EFF}, options={"btag_working_point": opts}))
    return df.select("k", *[r(c).alias(c) for c, _, _ in _MANY_COLUMNS], r("btag_weight_total_up").alias("total_up"), r("btag_weight_total_down").alias("total_down"))


def _sql_every_shape() -> str:
    a, p = _sql_where(20.1, 199.9)
    s = "least(greatest(score, 0.0001), 1.0999)"
    value = {n: sql_at(MANY_SHAPE, "=" + n, "flavour", a, p, s) for n in MANY_SHAPE.categories[0][1]}
    used = lambda n, fl: value[n] if fl is None else f"CASE WHEN flavour IN ({', '.join(map(str, fl))}) THEN {value[n]} ELSE {value['central']} END"
    cols = {"btag_shape": ("central", None)} | {f"btag_shape_{x}_{d}": (f"{d}_{x}", SHAPE_FLAVOURS[x]) for x in ALL_SHAPES for d in ("up", "down")}
    return ", ".join(f"round(product(CASE WHEN good AND abs(eta) <= 2.5 AND mass < 4.5 THEN {used(*x)} ELSE 1.0::DOUBLE END), 6) AS {c}" for c, x in cols.items())


@query(f"{SQL_GOOD} SELECT k, {_sql_every_shape()} FROM gj GROUP BY k")
def btag_all_shapes(spark, sf):
    """Shape weights of all eight sources."""
    opts = {"sources": ALL_SHAPES}
    df = apply_corrections(_good_jets(spark, sf), ["btag_shape"], Context(tables={"btag_shape": MANY_SHAPE}, options={"btag_shape": opts}))
    return df.select("k", *[r(c).alias(c) for c in df.columns if c.startswith("btag_shape")])


@query(
    f"""{SQL_GOOD}, {SQL_EV}, t AS (SELECT gj.*, CASE WHEN era < 1997 THEN 0.245 WHEN era < 1999 THEN 0.1917 ELSE 0.1272 END AS cut FROM gj JOIN ev USING (k))
SELECT k, round(product({_sql_factor('central', 'M').replace(f"score > {WPS['M']}", "score > cut")}), 6) AS weight FROM t GROUP BY k"""
)
def btag_by_era(spark, sf):
    """The combined weight with a threshold per era."""
    from eventloom.operators.corrections import tag_weight

    df = apply_corrections(jets(spark, sf, head=["era"]), ["jet_scale_mc"], Context(tables={"l2": L2}))
    df = df.withColumn("jets", F.transform("jets", lambda o: o.withField("good", (o["pt_jec"] > 20) & (F.abs(o["eta"]) < 2.2))))
    cut = F.when(F.col("era") < 1997, ERA_THRESHOLDS["2022"]).when(F.col("era") < 1999, ERA_THRESHOLDS["2023"]).otherwise(ERA_THRESHOLDS["2024"])
    df = df.withColumn("cut", cut)
    at = lambda o: (F.abs(V.clamp(o["eta"], -2.49, 2.49)), V.clamp(o["pt_jec"], 20.1, 999.9))
    w = tag_weight(
        F.col("jets"),
        lambda o: F.when(o["flavour"] == 0, 1.0).otherwise(BTAG_SF.at("central", "M", o["flavour"], *at(o))),
        lambda o: BTAG_EFF.at("M", o["flavour"], *at(o)),
        lambda o: o["score"] > F.col("cut"),
        lambda o: o["good"],
    )
    return df.select("k", r(w).alias("weight"))


def muons(spark, sf, *head):
    """Objects as muons; good ones by score."""
    ev = events(spark, sf, ["pt", "eta", "phi", "mass", "score", "charge"], head).filter(F.size("obj") > 0)
    return ev.withColumn("muons", F.transform("obj", lambda o: o.withField("good", o["score"] > 0.3))).drop("obj")


def _sql_mu(shift: str = "", direction: str = "nominal", what: str = "product") -> str:
    a, p = "least(greatest(eta, -2.39), 2.39)", "least(greatest(pt, 15.1), 1000.0)"
    f = " * ".join(sql_at(MUON_SF, "=" + c, "=" + (direction if c == shift else "nominal"), a, p) for c in ("id", "mva"))
    return f"CASE WHEN max(CASE WHEN score > 0.3 AND pt > 20 THEN 1 ELSE 0 END) = 1 THEN product(CASE WHEN score > 0.3 AND pt > 15 THEN {f} ELSE 1.0::DOUBLE END) ELSE 1.0::DOUBLE END"


@query(
    f"""WITH {SQL_OBJ}, e AS (SELECT k, {_sql_mu()} AS n, {_sql_mu('id', 'up')} AS iu, {_sql_mu('mva', 'up')} AS mu, {_sql_mu('id', 'down')} AS id_, {_sql_mu('mva', 'down')} AS md,
  max(CASE WHEN i = 1 THEN {sql_at(MUON_SF, '=id', '=nominal', 'least(greatest(eta, -2.39), 2.39)', 'least(greatest(pt, 15.1), 1000.0)')} * {sql_at(MUON_SF, '=mva', '=nominal', 'least(greatest(eta, -2.39), 2.39)', 'least(greatest(pt, 15.1), 1000.0)')} END) AS one FROM obj GROUP BY k)
SELECT k, round(n, 6) AS muon_weight, round(n + sqrt(power(iu - n, 2) + power(mu - n, 2)), 6) AS muon_weight_up, round(greatest(0, n - sqrt(power(n - id_, 2) + power(n - md, 2))), 6) AS muon_weight_down, round(coalesce(one, 1), 6) AS indexed FROM e"""
)
def muon_efficiency_weight(spark, sf):
    """Efficiency weight of good muons with shifts; that of one indexed muon."""
    ctx = Context(tables={"muon_sf": MUON_SF})
    df = apply_corrections(muons(spark, sf).withColumn("second", F.lit(1)), ["muon_efficiency"], ctx)
    ctx = Context(tables={"muon_sf": MUON_SF}, options={"muon_efficiency": {"index": "second", "out": "indexed"}})
    df = apply_corrections(df, ["muon_efficiency"], ctx)
    return df.select("k", *[r(c).alias(c) for c in ("muon_weight", "muon_weight_up", "muon_weight_down", "indexed")])


@query(
    f"""WITH {SQL_OBJ}, e AS (SELECT k, max(CASE WHEN i = 0 THEN pt END) AS p1, max(CASE WHEN i = 1 THEN pt END) AS p2 FROM obj GROUP BY k)
SELECT k, round({sql_at(TRIGGER_1D, '=nominal', 'p1')}, 9) AS one, round({sql_at(TRIGGER_1D, '=up', 'p1')}, 9) AS one_up, round(CASE WHEN p2 IS NULL THEN 1.0::DOUBLE ELSE {sql_at(TRIGGER_2D, '=nominal', 'p1', 'p2')} END, 9) AS two, 1.0::DOUBLE AS none FROM e"""
)
def trigger_weight(spark, sf):
    """Trigger weight by one or two pt; the first known era tag, else unity."""
    df = muons(spark, sf).withColumns({"lead_idx": F.lit(0), "sublead_idx": F.lit(1)})
    ctx = lambda tags, out: Context(tables={"trigger_1D": TRIGGER_1D, "trigger_2D": TRIGGER_2D}, options={"trigger": {"tags": tags, "out": out}})
    for tags, out in ((["missing", "1D"], "one"), (["2D", "1D"], "two"), (["missing"], "none")):
        df = apply_corrections(df, ["trigger"], ctx(tags, out))
    return df.select("k", *[r(c, 9).alias(c) for c in ("one", "one_up", "two", "none")])


SQL_MS = f"""WITH {SQL_OBJ}, {SQL_EV}, s AS (SELECT obj.*, block, CASE WHEN pt BETWEEN 26 AND 200 AND abs(eta) <= 2.4 THEN 1 / ({sql_at(MUON_SCALE, '=m', 'eta', 'phi')} / pt + charge * {sql_at(MUON_SCALE, '=a', 'eta', 'phi')}) ELSE pt END AS ps FROM obj JOIN ev USING (k)),
q AS (SELECT *, abs(eta) AS ae FROM s),
u AS (SELECT *, {sql_at(SMEAR_QUANTILE, 'ae', _sql_u('r', 'k', 'block', 'phi_r'))} AS rr, greatest(0.0::DOUBLE, {sql_at(SMEAR_SIGMA, '=p0', 'ae')} + {sql_at(SMEAR_SIGMA, '=p1', 'ae')} * ps + {sql_at(SMEAR_SIGMA, '=p2', 'ae')} * ps * ps) AS sg,
  sqrt(greatest(0.0::DOUBLE, power({sql_at(SMEAR_K, '=data', 'ae')}, 2) - power({sql_at(SMEAR_K, '=mc', 'ae')}, 2))) AS kk FROM (SELECT *, CAST(floor(phi * 100 + 0.5) AS BIGINT) AS phi_r FROM q)),
c AS (SELECT *, CASE WHEN ps BETWEEN 26 AND 200 AND abs(eta) <= 2.4 AND (1 + kk * sg * rr) BETWEEN 0.1 AND 2 THEN ps * (1 + kk * sg * rr) ELSE ps END AS pc FROM u)"""


@query(
    f"""{SQL_MS} SELECT k, i, round(ps, 6) AS pt_scaled, round(pc, 6) AS pt_corr,
  round(CASE WHEN kk > 0 THEN ps * (1 + (kk + {sql_at(SMEAR_K, '=unc', 'ae')}) * ((pc / ps - 1) / kk)) ELSE pc END, 6) AS pt_reso_up,
  round(pc + pc * pc * sqrt(greatest(0.0::DOUBLE, power({sql_at(MUON_SCALE, '=stat_m', 'eta', 'phi')}, 2) / (pc * pc) + power({sql_at(MUON_SCALE, '=stat_a', 'eta', 'phi')}, 2) + 2 * charge * {sql_at(MUON_SCALE, '=rho', 'eta', 'phi')} * {sql_at(MUON_SCALE, '=stat_m', 'eta', 'phi')} / pc * {sql_at(MUON_SCALE, '=stat_a', 'eta', 'phi')})), 6) AS pt_scale_up FROM c"""
)
def muon_momentum(spark, sf):
    """Momentum scale and smear with keyed draws, and their variations."""
    tables = {"muon_scale": MUON_SCALE, "smear_sigma": SMEAR_SIGMA, "smear_k": SMEAR_K, "smear_quantile": SMEAR_QUANTILE}
    ctx = Context(tables=tables, options={"muon_smear": {"key": ["k", "block"]}})
    df = apply_corrections(muons(spark, sf, "block"), ["muon_scale", "muon_smear"], ctx)
    out = per_jet(df, "pt_scaled", "pt_corr", "pt_reso_up", "pt_scale_up", coll="muons")
    return out.select("k", "i", *[r(c).alias(c) for c in ("pt_scaled", "pt_corr", "pt_reso_up", "pt_scale_up")])


def _sql_guarded(v: str) -> str:
    return f"(CASE WHEN {v} / ps > 2 OR {v} / ps < 0.1 OR {v} < 0 THEN ps ELSE {v} END)"


def _sql_momentum(sign: str) -> str:
    unc = f"sqrt(greatest(0.0::DOUBLE, power({sql_at(MUON_SCALE, '=stat_m', 'eta', 'phi')}, 2) / (pc * pc) + power({sql_at(MUON_SCALE, '=stat_a', 'eta', 'phi')}, 2) + 2 * charge * {sql_at(MUON_SCALE, '=rho', 'eta', 'phi')} * {sql_at(MUON_SCALE, '=stat_m', 'eta', 'phi')} / pc * {sql_at(MUON_SCALE, '=stat_a', 'eta', 'phi')}))"
    reso = f"ps * (1 + (kk {sign} {sql_at(SMEAR_K, '=unc', 'ae')}) * ((pc / ps - 1) / nullif(kk, 0)))"
    return f"round(CASE WHEN kk > 0 AND ae <= 2.4 THEN {_sql_guarded(reso)} ELSE pc END, 6), round(CASE WHEN ae <= 2.4 THEN pc {sign} pc * pc * {unc} ELSE pc END, 6)"


@query(f"{SQL_MS}, d(k, i, side, reso, scale) AS (SELECT k, i, 'up', {_sql_momentum('+')} FROM c UNION ALL SELECT k, i, 'down', {_sql_momentum('-')} FROM c) SELECT k, i, side, reso, scale FROM d")
def muon_momentum_sides(spark, sf):
    """Both sides of the resolution and of the scale of the muon momentum."""
    tables = {"muon_scale": MUON_SCALE, "smear_sigma": SMEAR_SIGMA, "smear_k": SMEAR_K, "smear_quantile": SMEAR_QUANTILE}
    ctx = Context(tables=tables, options={"muon_smear": {"key": ["k", "block"]}})
    df = apply_corrections(muons(spark, sf, "block"), ["muon_scale", "muon_smear"], ctx)
    out = per_jet(df, *[f"pt_{v}_{d}" for v in ("reso", "scale") for d in ("up", "down")], coll="muons")
    sides = F.array(*[F.struct(F.lit(d).alias("side"), r(f"pt_reso_{d}").alias("reso"), r(f"pt_scale_{d}").alias("scale")) for d in ("up", "down")])
    return out.select("k", "i", F.inline(sides))


def gen_events(spark, sf):
    """Objects as generator particles (codes from their numbers) and jets."""
    ev = events(spark, sf, ["pt", "eta", "phi", "part", "supp"], ["channel"]).filter(F.size("obj") > 0)
    code = lambda o: F.when(o["supp"] % 5 == 0, 6).when(o["supp"] % 5 == 1, 25).when(o["supp"] % 5 == 2, 13).otherwise(500 + o["part"] % 100)
    gen = F.transform(
        "obj",
        lambda o, i: F.struct(
            code(o).cast("int").alias("pdg"),
            (i - 1).alias("mother"),
            F.lit(1).alias("status"),
            F.shiftleft(o["part"] % 2, 13).cast("int").alias("flags"),
            *[o[c].alias(c) for c in ("pt", "eta", "phi")],
        ),
    )
    genjets = F.transform(
        F.filter("obj", lambda o, i: i % 2 == 0),
        lambda o: F.struct(
            F.when(o["part"] % 3 == 0, 0).otherwise(5).alias("hadron_flavour"), o["pt"].alias("pt"), (o["eta"] + 0.1).alias("eta"), o["phi"].alias("phi")
        ),
    )
    return ev.select("k", "channel", gen.alias("gen"), genjets.alias("genjets"))


SQL_GEN = f"""WITH {SQL_OBJ}, a AS (SELECT *, CAST(CASE supp % 5 WHEN 0 THEN 6 WHEN 1 THEN 25 WHEN 2 THEN 13 ELSE 500 + part % 100 END AS INTEGER) AS code, part % 2 = 1 AS last_copy FROM obj),
t AS (SELECT a.k, a.i, a.eta, a.phi, a.code >= 500 AND NOT coalesce(c.code >= 500, FALSE) AS terminal FROM a LEFT JOIN a c ON a.k = c.k AND c.i = a.i + 1),
o AS (SELECT t.k, t.i, t.eta, t.phi, coalesce(arg_max(u.code, u.i), 1) AS src FROM t LEFT JOIN a u ON t.k = u.k AND u.i < t.i AND u.code IN (6, 25) WHERE terminal GROUP BY ALL),
j AS (SELECT k, i, CASE WHEN part % 3 = 0 THEN 0 ELSE 5 END AS fl, pt, eta + 0.1::DOUBLE AS eta, phi FROM a WHERE i % 2 = 0),
m AS (SELECT DISTINCT j.k, j.i FROM j JOIN a l ON j.k = l.k AND l.code = 13 AND l.last_copy AND l.pt >= 15 AND abs(l.eta) < 2.4 WHERE {sql_folded('j', 'l')} < 0.4),
n AS (SELECT k, i, arg_min(src, (d, oi)) AS src FROM (SELECT j.k, j.i, o.i AS oi, o.src, {sql_folded('j', 'o')} AS d FROM j JOIN o ON j.k = o.k) WHERE d < 0.4 GROUP BY k, i)"""


def _sql_overlap(masked: bool, enriched: bool) -> str:
    mask = "WHEN m.k IS NOT NULL THEN -13" if masked else ""
    return f"""{SQL_GEN}, s AS (SELECT j.k, CASE WHEN NOT (fl = 5 AND j.pt > 20 AND abs(j.eta) < 2.5) THEN -1 {mask} ELSE coalesce(n.src, -2) END AS source
  FROM j LEFT JOIN m ON j.k = m.k AND j.i = m.i LEFT JOIN n ON j.k = n.k AND j.i = n.i),
c AS (SELECT k, CAST(count(*) FILTER (source <> 6 AND source > 0) AS INTEGER) AS n_additional, CAST(count(*) FILTER (source = 6) AS INTEGER) AS n_from_top, CAST(count(*) FILTER (source = -13) AS INTEGER) AS n_masked FROM s GROUP BY k)
SELECT * FROM c WHERE n_additional {'>= 1' if enriched else '= 0'}"""


@query(_sql_overlap(True, True))
def overlap_enriched(spark, sf):
    """Enriched sample: events with an additional fiducial b jet, muons masked."""
    ctx = Context(dataset="TTBB_DL", options={"overlap": {"leptons": muon_for_overlap}})
    return apply_corrections(gen_events(spark, sf), ["overlap"], ctx).select("k", "n_additional", "n_from_top", "n_masked")


@query(_sql_overlap(False, False))
def overlap_inclusive(spark, sf):
    """Inclusive sample under the older rule without masking."""
    ctx = Context(dataset="ttbarSL", options={"overlap": {"rule": "v2"}})
    return apply_corrections(gen_events(spark, sf), ["overlap"], ctx).select("k", "n_additional", "n_from_top", "n_masked")


@query(
    _sql_overlap(True, True)
    .replace("l.code = 13 AND l.last_copy AND l.pt >= 15 AND abs(l.eta) < 2.4", "l.code = 13 AND l.last_copy AND l.pt >= 25 AND abs(l.eta) < 2.4")
)
def overlap_two_leptons(spark, sf):
    """Electron and muon masking."""
    ctx = Context(dataset="ttbb", options={"overlap": {"leptons": lepton_for_overlap}})
    return apply_corrections(gen_events(spark, sf), ["overlap"], ctx).select("k", "n_additional", "n_from_top", "n_masked")


@query(
    f"""WITH {SQL_OBJ}, a AS (SELECT *, CAST(CASE supp % 5 WHEN 0 THEN 6 WHEN 1 THEN 25 WHEN 2 THEN 13 ELSE 500 + part % 100 END AS INTEGER) AS code FROM obj),
h AS (SELECT *, code >= 500 AND part % 2 = 1 AS b FROM a),
t AS (SELECT h.k, h.i, h.eta, h.phi FROM h LEFT JOIN h c ON h.k = c.k AND c.i = h.i + 1 WHERE h.b AND NOT coalesce(c.b, FALSE)),
o AS (SELECT t.k, t.i, t.eta, t.phi, coalesce(arg_max(u.code, u.i), -2) AS src FROM t LEFT JOIN a u ON t.k = u.k AND u.i BETWEEN t.i - 9 AND t.i - 1 AND u.code IN (6, 25) GROUP BY ALL),
j AS (SELECT k, i, part % 3 <> 0 AS fl, eta + 0.1::DOUBLE AS eta, phi FROM a WHERE i % 2 = 0),
n AS (SELECT k, i, arg_min(src, (d, oi)) AS src FROM (SELECT j.k, j.i, o.i AS oi, o.src, {sql_folded('j', 'o')} AS d FROM j JOIN o ON j.k = o.k) WHERE d < 0.4 GROUP BY k, i)
SELECT k, CAST(count(*) FILTER (fl AND coalesce(src, -1) NOT IN (6, -1)) AS INTEGER) AS n_additional FROM j LEFT JOIN n USING (k, i) GROUP BY k HAVING count(*) FILTER (fl AND coalesce(src, -1) NOT IN (6, -1)) < 2"""
)
def overlap_first_rule(spark, sf):
    """The first rule: fewer than two additional jets, last copies only."""
    ctx = Context(dataset="anything", options={"overlap": {"rule": "v1"}})
    return apply_corrections(gen_events(spark, sf), ["overlap"], ctx).select("k", "n_additional")


def sql_trigger_study(selected: str) -> str:
    return f"""WITH {SQL_OBJ}, kept AS (SELECT *, part % 7 <> 0 AS id FROM obj WHERE k % 11 <> 0), mu AS (SELECT o.k, o.i, o.pt, o.eta, o.phi, o.rel AS mini, o.rel * 1.5::DOUBLE AS pf, o.score AS jri, o.score AS mva, o.mass / 20 AS df,
    abs((o.part % 13) / 100.0::DOUBLE - 0.065::DOUBLE) < 0.05 AND abs((o.supp % 9) / 35.0::DOUBLE - 0.12::DOUBLE) < 0.1 AND o.part % 10 < 8 AND o.charge + o.part % 5 > 0 AS fine,
    CASE WHEN t.pt > 15 AND t.id THEN t.pt END AS jpt, CASE WHEN t.pt > 15 AND t.id THEN {sql_dr('o', 't')} END AS jdr FROM kept o LEFT JOIN kept t ON o.k = t.k AND t.i = o.i - 1),
m1 AS (SELECT *, coalesce(jpt, -999) AS jet_pt, coalesce(jdr, 999) AS jet_dr, CASE WHEN jdr < 0.4 THEN df ELSE 0 END AS dfc FROM mu),
m2 AS (SELECT *, mva >= 0.64 AND dfc < 0.248 AS pm, CASE WHEN jet_dr < 0.4 THEN jet_pt / pt - 1 ELSE pf END AS iso FROM m1),
m3 AS (SELECT *, CASE WHEN pm THEN pt WHEN jet_dr <= 0.4 THEN 0.9 * jet_pt ELSE pt / (1 + mini) END AS cone FROM m2),
l AS (SELECT * FROM m3 WHERE cone > 15 AND abs(eta) < 2.4 AND fine AND mini < 0.4 AND ({selected})),
one AS (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM l QUALIFY c = 1),
f AS (SELECT one.k, one.i, one.pt AS lead_pt, one.cone, one.iso, jt.i AS ji, jt.pt AS jpt2 FROM one JOIN kept jt ON one.k = jt.k WHERE jt.id AND jt.pt > 30 AND {sql_dr('jt', 'one')} > 0.7)
SELECT k, CAST(i AS INTEGER) AS lead_idx, round(lead_pt, 9) AS lead_pt, round(cone, 6) AS lead_cone_pt, round(iso, 6) AS lead_rel_iso, CAST(count(*) AS INTEGER) AS n_iso_jet, round(arg_min(jpt2, ji), 9) AS lead_jet_pt FROM f GROUP BY k, i, lead_pt, cone, iso"""


def _trigger_study(spark, sf, **opts):
    ev = nested(spark, sf, "pt", "eta", "phi", "rel", "score", "mass", "part", "supp", "charge")
    mu = F.transform(
        "obj",
        lambda o, i: F.struct(
            o["pt"].alias("pt"), o["eta"].alias("eta"), o["phi"].alias("phi"), o["rel"].alias("mini_iso"), (o["rel"] * 1.5).alias("pf_iso"), o["score"].alias("jet_rel_iso"), o["score"].alias("mva"),
            (o["mass"] / 20.0).alias("jet_df"), (i - 1).alias("jet_idx"), ((o["part"] % 13) / F.lit(100.0) - 0.065).alias("dxy"), ((o["supp"] % 9) / F.lit(35.0) - 0.12).alias("dz"),
            (o["part"] % 10).cast("double").alias("sip3d"), (o["charge"] + o["part"] % 5 > 0).alias("medium_id"),
        ),
    )
    jets = F.transform("obj", lambda o: F.struct(o["pt"].alias("pt"), o["eta"].alias("eta"), o["phi"].alias("phi"), (o["part"] % 7 != 0).alias("id_tight")))
    df = ev.select("k", F.when(F.col("k") % 11 == 0, 0.0).otherwise(F.lit(1.0)).alias("veto_weight"), mu.alias("muons"), jets.alias("jets"))
    out = apply_corrections(df, ["trigger_study"], Context(options={"trigger_study": opts}))
    return out.select("k", "lead_idx", r("lead_pt", 9).alias("lead_pt"), r("lead_cone_pt").alias("lead_cone_pt"), r("lead_rel_iso").alias("lead_rel_iso"), "n_iso_jet", r("lead_jet_pt", 9).alias("lead_jet_pt"))


@query(sql_trigger_study("pm OR mva < 0.64 AND jri < 0.5 AND dfc < CASE WHEN cone >= 45 THEN 0.0485 WHEN cone > 20 THEN (45 - cone) * 0.00798 + 0.0485 ELSE 0.248 END"))
def trigger_study_objects(spark, sf):
    """Weight filter, linked jets, cone pt, both isolations, fakeable muons, one muon
    and a recoil jet."""
    return _trigger_study(spark, sf, fakeable=True)


@query(sql_trigger_study("pm OR mva < 0.64 AND jri < 0.5 AND dfc < 0.248"))
def trigger_study_tuned(spark, sf):
    """Fakeable muons with one cut on the tag."""
    return _trigger_study(spark, sf, fakeable=True, tuned=True)


@query(sql_trigger_study("TRUE"))
def trigger_study_loose(spark, sf):
    """The stage of loose muons."""
    return _trigger_study(spark, sf)
