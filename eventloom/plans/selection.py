"""Step lists, variants, envelopes and the flagship job."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators import histogram as H
from eventloom.operators import steps as S
from eventloom.plans.jobs import SkimJob
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, events, heads, nested, r, sql_bin

PT = Axis("lead_pt", 20, 0.0, 100.0)

SELECT_TWO = S.StepList(
    [
        ("define", "good", "filter(obj, o -> o.pt > 20 AND abs(o.eta) < 2.0)"),
        ("define", "n_good", "size(good)"),
        ("define", "lead_pt", "get(good, 0).pt"),
        ("cut", "two_good", "n_good >= 2"),
    ]
)

SQL_TWO = f"""WITH {SQL_OBJ}, {SQL_EV},
good AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM obj WHERE pt > 20 AND abs(eta) < 2.0),
sel AS (SELECT k, count(*) AS n_good, max(CASE WHEN g = 1 THEN pt END) AS lead_pt FROM good GROUP BY k HAVING count(*) >= 2)"""

LUMI = {1995: 1.5, 1996: 2.0, 1997: 2.5, 1998: 3.0, 1999: 3.5, 2000: 4.0, 2001: 4.5}


def era_factor():
    out = None
    for era, v in LUMI.items():
        out = F.when(F.col("era") == era, F.lit(v)) if out is None else out.when(F.col("era") == era, F.lit(v))
    return out


@query(
    SQL_TWO
    + f""", h AS (
  SELECT era, least(greatest({sql_bin("lead_pt", 20, 0.0, 100.0)}, 1), 20) AS ix, w FROM sel JOIN ev USING (k)),
l AS (SELECT * FROM (VALUES {", ".join(f"({e}, {v}::DOUBLE)" for e, v in LUMI.items())}) t(era, lumi))
SELECT era, ix, count(*) AS n, round(sum(w) * any_value(lumi), 9) AS sumw, round(sum(w * w) * any_value(lumi) * any_value(lumi), 6) AS sumw2
FROM h JOIN l USING (era) GROUP BY era, ix"""
)
def flagship_collect(spark, sf):
    """Objects -> mask -> cut -> weighted histogram -> luminosity -> folded flow."""
    ev = S.apply_steps(events(spark, sf, ["pt", "eta"], ["w", "era"]), SELECT_TWO)
    hist = H.fill(ev, [PT], F.col("w"), ["era"])
    hist = H.fold_flow(H.scale(hist, era_factor()), ["era"], PT.n)
    return hist.select("era", "ix", "n", r("sumw", 9).alias("sumw"), r("sumw2").alias("sumw2"))


@query(SQL_TWO + " SELECT k, CAST(n_good AS INTEGER) AS n_good, round(lead_pt, 6) AS lead_pt FROM sel")
def step_list(spark, sf):
    """define and cut in list order."""
    ev = S.apply_steps(nested(spark, sf, "pt", "eta"), SELECT_TWO)
    return ev.select("k", "n_good", r("lead_pt").alias("lead_pt"))


@query(
    f"""WITH {SQL_EV}, d AS (SELECT k, w * 2 AS x FROM ev WHERE w > 0.5)
SELECT k, round(x + 1, 9) AS x FROM d WHERE x + 1 < 6"""
)
def step_redefine(spark, sf):
    """redefine acts on later steps only."""
    steps = S.StepList(
        [("define", "x", "w * 2"), ("cut", "first", "x > 1"), ("redefine", "x", "x + 1"), ("cut", "second", "x < 6")]
    )
    return S.apply_steps(heads(spark, sf, "w"), steps).select("k", r("x", 9).alias("x"))


@query(f"""WITH {SQL_EV}, d AS (SELECT k, w * 2 + 1 AS x FROM ev) SELECT k, round(x, 9) AS x FROM d WHERE x > 1.5 AND x < 6""")
def step_hoisted(spark, sf):
    """Definitions first, then cuts: the redefinition acts on the earlier cut,
    and a cut named like a definition is dropped."""
    steps = S.StepList(
        [
            ("define", "x", "w * 2"),
            ("cut", "first", "x > 1.5"),
            ("redefine", "x", "x + 1"),
            ("cut", "second", "x < 6"),
            ("cut", "x", "w > 100"),
        ]
    )
    return S.apply_steps(heads(spark, sf, "w"), steps.hoisted()).select("k", r("x", 9).alias("x"))


@query(
    SQL_TWO.replace(" HAVING count(*) >= 2", "")
    + " SELECT k, CAST(n_good AS INTEGER) AS n_good, round(lead_pt, 6) AS lead_pt, CAST(n_good * 2 AS INTEGER) AS twice FROM sel"
)
def step_skipping(spark, sf):
    """Concatenate lists, append a step, skip steps by name, definitions only."""
    steps = (SELECT_TWO + S.StepList([("cut", "three_good", "n_good >= 3")])).appended("define", "twice", "n_good * 2")
    without = steps.without({"two_good", "three_good"})
    ev = S.apply_steps(nested(spark, sf, "pt", "eta"), without.definitions(lambda n: n != "twice"))
    ev = S.apply_steps(ev, without.definitions(lambda n: n == "twice")).filter("n_good > 0")
    return ev.select("k", "n_good", r("lead_pt").alias("lead_pt"), "twice")


P4_STEPS = S.StepList(
    [
        ("define", "pt1", "get(obj, 0).pt"),
        ("define", "eta1", "get(obj, 0).eta"),
        ("define", "phi1", "get(obj, 0).phi"),
        ("define", "m1", "get(obj, 0).mass"),
        ("define", "eta2", "get(obj, 1).eta"),
        ("define", "phi2", "get(obj, 1).phi"),
        ("cut", "two", "size(obj) >= 2"),
        ("TLVPtEtaPhiM", "v", "pt1, eta1, phi1, m1"),
        ("TLVPtEtaPhiM_corr", "vc", "pt1,eta1,phi1,m1"),
        ("TLVPtEtaPhiE", "ve", "pt1,eta1,phi1,pt1"),
        ("defineDR", "dr", "eta1,eta2,phi1,phi2"),
    ]
)


@query(
    f"""WITH {SQL_OBJ}, a AS (SELECT a.*, b.eta AS eta2, b.phi AS phi2 FROM obj a JOIN obj b ON a.k = b.k AND a.i = 0 AND b.i = 1)
SELECT k, round(pt * cos(phi), 6) AS px, round(pt * sinh(eta), 6) AS pz,
  round(sqrt(pt * cosh(eta) * pt * cosh(eta) + mass * mass), 6) AS e, round(pt, 6) AS e_given,
  round(sqrt(pt * cosh(eta) * pt * cosh(eta) + mass * mass), 6) AS e_corr,
  round(sqrt((eta - eta2) * (eta - eta2) + power(CASE WHEN abs(phi - phi2) > 3.1416 THEN 6.2832::DOUBLE - abs(phi - phi2) ELSE abs(phi - phi2) END, 2)), 6) AS dr
FROM a"""
)
def step_four_vectors(spark, sf):
    """Four-vector steps and the distance step with its rounded constants."""
    ev = S.apply_steps(nested(spark, sf, "pt", "eta", "phi", "mass"), P4_STEPS)
    return ev.select(
        "k",
        r("v.px").alias("px"),
        r("v.pz").alias("pz"),
        r("v.e").alias("e"),
        r("ve.e").alias("e_given"),
        r("vc.e").alias("e_corr"),
        r("dr").alias("dr"),
    )


VARIED = S.StepList(
    [
        ("define", "n_hard", "size(filter(obj, o -> o.pt > 30))"),
        ("cut", "one hard", "n_hard >= 1"),
        ("define", "lead", "array_max(transform(obj, o -> o.pt))"),
        ("cut", "lead-high", "lead > 60"),
    ]
)


def _shifted_obj(df):
    shift = lambda s: F.transform("obj", lambda o: F.struct((o["pt"] * (1.0 + s * o["rel"])).alias("pt"), o["rel"].alias("rel")))
    return df.withColumns({"obj_up": shift(1.0), "obj_down": shift(-1.0)})


SQL_VARIED = f"""WITH {SQL_OBJ}, v AS (
  SELECT k, CAST(sum(CASE WHEN pt > 30 THEN 1 ELSE 0 END) AS INTEGER) AS n_hard, max(pt) AS lead,
    CAST(sum(CASE WHEN pt * (1 + rel) > 30 THEN 1 ELSE 0 END) AS INTEGER) AS n_hard_up, max(pt * (1 + rel)) AS lead_up,
    CAST(sum(CASE WHEN pt * (1 - rel) > 30 THEN 1 ELSE 0 END) AS INTEGER) AS n_hard_down, max(pt * (1 - rel)) AS lead_down
  FROM obj GROUP BY k)"""


@query(
    SQL_VARIED
    + """ SELECT k, n_hard, n_hard_up, round(lead_up, 9) AS lead_up,
  n_hard_up >= 1 AS pass_one_hard_up, n_hard_up >= 1 AND lead_up > 60 AS pass_lead_high_up, n_hard_up >= 1 AND lead_up > 60 AS pass_all_up,
  n_hard_down >= 1 AND lead_down > 60 AS ok_down
FROM v"""
)
def variant_flags(spark, sf):
    """Nominal and two variants in one scan, cuts kept as cumulative flags."""
    ev = _shifted_obj(nested(spark, sf, "pt", "rel"))
    ev = S.apply_steps(ev, VARIED.definitions())
    ev = S.apply_variant(ev, VARIED, "_up", {"obj": "obj_up"}, flags=True)
    ev = S.apply_variant(ev, VARIED, "_down", {"obj": "obj_down"}, flags=True, final_flag="ok_down")
    return ev.select(
        "k", "n_hard", "n_hard_up", r("lead_up", 9).alias("lead_up"), "pass_one_hard_up", "pass_lead_high_up", "pass_all_up", "ok_down"
    )


@query(SQL_VARIED + " SELECT k, n_hard_down AS n, round(lead_down, 9) AS lead FROM v WHERE n_hard_down >= 1")
def variant_filtered(spark, sf):
    """A variant that filters on chosen cuts only; columns found by nominal name."""
    ev = S.apply_variant(_shifted_obj(nested(spark, sf, "pt", "rel")), VARIED, "_down", {"obj": "obj_down"}, cuts={"one hard"})
    name = lambda n: S.variant_name(n, VARIED, "_down", {"obj": "obj_down"})
    return ev.select("k", F.col(name("n_hard")).alias("n"), r(name("lead"), 9).alias("lead"))


@query(
    f"""WITH {SQL_OBJ}, o AS (
  SELECT k, pt, pt + sqrt((pt * rel) * (pt * rel) + power(greatest(0.0::DOUBLE, greatest(pt * (1 + score / 10), pt * (1 - score / 10)) - pt), 2)) AS top, score FROM obj)
SELECT k, CAST(sum(CASE WHEN pt > 25 THEN 1 ELSE 0 END) AS INTEGER) AS n_nominal
FROM o GROUP BY k HAVING sum(CASE WHEN top > 25 AND score >= 0.2 THEN 1 ELSE 0 END) >= 2"""
)
def envelope_selection(spark, sf):
    """Rows that could pass under any variation."""
    ev = nested(spark, sf, "pt", "rel", "score").withColumn(
        "obj",
        F.transform(
            "obj", lambda o: o.withField("up", 1.0 + o["score"] / 10.0).withField("down", 1.0 - o["score"] / 10.0).withField("raw", o["pt"])
        ),
    )
    kept = S.envelope_filter(ev, "obj", "pt", ["rel"], lambda o: o["score"] >= 0.2, 2, 25.0, ("raw", "up", "down"))
    return kept.select("k", F.size(F.filter("obj", lambda o: o["pt"] > 25)).alias("n_nominal"))


@query(
    f"""WITH {SQL_EV}, f AS (SELECT k, channel, w - 2 AS veto, w - 1.5 AS veto_up, w - 2.5 AS veto_down FROM ev)
SELECT channel, count(*) AS n FROM f WHERE veto > 0 OR veto_up > 0 OR veto_down > 0 GROUP BY channel"""
)
def envelope_flags(spark, sf):
    """Any of all columns with a prefix positive."""
    ev = heads(spark, sf, "w", "channel").selectExpr("channel", "w - 2 AS veto", "w - 1.5D AS veto_up", "w - 2.5D AS veto_down")
    return ev.filter(S.any_positive(ev, "veto")).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_orderkey AS k, round(l_extendedprice / 1000, 6) AS pt, round(l_extendedprice / 1000 / 0.5, 6) AS pt_half, l_tax AS syst,
  CASE WHEN l_extendedprice / 1000 < 20 THEN 0.1::DOUBLE WHEN l_extendedprice / 1000 < 30 THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS tf,
  round(l_discount / (0.5 * l_tax + 0.25 * l_quantity + 0.000001), 6) AS mix
FROM lineitem"""
)
def derived_columns(spark, sf):
    """Optional columns, column-or-expression specs, piecewise factors, score mix."""
    from eventloom.plans.tables import table

    li = table(spark, sf, "lineitem").withColumn("raw_pt", F.col("l_extendedprice") / 1000.0)
    li = S.first_available(li, "pt", ["corrected_pt", "scaled_pt", "raw_pt"])
    return li.select(
        F.col("l_orderkey").alias("k"),
        r("pt").alias("pt"),
        r(S.column_or_expr(li, "pt / 0.5D")).alias("pt_half"),
        S.column_or_expr(li, "l_tax").alias("syst"),
        S.piecewise(F.col("pt"), [(None, 20.0, 0.1), (20.0, 30.0, 0.2), (30.0, None, 0.3)]).alias("tf"),
        r(F.expr("l_discount / (0.5D * l_tax + 0.25D * l_quantity + 0.000001D)")).alias("mix"),
    )


@query(
    f"""WITH {SQL_EV}, {SQL_OBJ}, f AS (SELECT k, max(CASE WHEN i = 0 THEN flag END) = 'N' AS lead, max(CASE WHEN i = 1 THEN flag END) = 'N' AS sub FROM obj GROUP BY k)
SELECT coalesce(lead, FALSE) AS lead_prompt, coalesce(sub, FALSE) AS sublead_prompt, count(*) AS n, round(sum(w), 9) AS sumw FROM ev LEFT JOIN f USING (k) GROUP BY 1, 2"""
)
def complementary_parts(spark, sf):
    """One flag per part instead of two filters: parts are written by flag."""
    from eventloom.operators.splits import prompt_flags

    ev = events(spark, sf, ["flag"], ["w"])
    prompt = lambda i: F.coalesce(F.get("obj", F.lit(i))["flag"] == "N", F.lit(False))
    ev = prompt_flags(ev, prompt(0), prompt(1))
    return ev.groupBy("lead_prompt", "sublead_prompt").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w"), 9).alias("sumw"))


@query(
    f"""WITH {SQL_EV} SELECT k, status, round(w, 9) AS w, CASE WHEN status = 'F' THEN w > 1 ELSE w > 0.5 END AS kept FROM ev
WHERE CASE WHEN status = 'F' THEN w > 1 ELSE w > 0.5 END"""
)
def data_or_simulation(spark, sf):
    """Parts of a pipeline that apply to data only or to simulation only."""
    ev = heads(spark, sf, "status", "w")
    data = SkimJob(S.StepList([("cut", "range", "w > 0.8D")]), ["k", "status", "w", "seen"], is_data=True, data_filter=lambda d: d.filter("w > 1"), after=S.StepList([("define", "seen", "w > 1")]))
    simulation = SkimJob(S.StepList([("cut", "range", "w > 0.5D")]), ["k", "status", "w", "seen"], data_filter=lambda d: d.filter("w > 9"), after=S.StepList([("define", "seen", "w > 0.5D")]))
    parts = [job.rows(ev.filter((F.col("status") == "F") == F.lit(job.is_data))) for job in (data, simulation)]
    return parts[0].unionByName(parts[1]).select("k", "status", r("w", 9).alias("w"), F.col("seen").alias("kept"))


HARD = S.StepList([("define", "n_hard", "size(filter(obj, o -> o.pt > 40))"), ("cut", "two hard", "n_hard >= 2"), ("cut", "light", "w > 0.3D"), ("define", "w2", "w * w")])


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, n AS (SELECT k, CAST(sum(CASE WHEN pt > 40 THEN 1 ELSE 0 END) AS INTEGER) AS n_hard, CAST(sum(CASE WHEN pt * (1 + rel) > 40 THEN 1 ELSE 0 END) AS INTEGER) AS n_up FROM obj GROUP BY k),
kept AS (SELECT ev.*, n_hard, n_up FROM ev JOIN n USING (k) WHERE n_up >= 2 AND w > 0.3::DOUBLE),
a AS (SELECT channel, count(*) AS n_rows, sum(w) AS sum_w FROM ev GROUP BY channel)
SELECT channel, n_rows, round(sum_w, 6) AS sum_w, count(kept.k) AS n_kept, count(*) FILTER (n_hard >= 2) AS n_nominal, round(coalesce(sum(kept.w * kept.w), 0), 6) AS sum_w2
FROM a LEFT JOIN kept USING (channel) GROUP BY channel, n_rows, a.sum_w"""
)
def systematic_skim(spark, sf):
    """Envelope skim written with its ledger and read back: events that pass under a
    variation only are kept, totals count events before any cut."""
    import uuid

    from eventloom.session import shared_dir
    from eventloom.sources.histstore import snapshot
    from eventloom.sources.ledger import ledger

    ev = events(spark, sf, ["pt", "rel"], ["w", "channel"])
    envelope = lambda d: S.envelope_filter(d, "obj", "pt", ["rel"], lambda o: F.lit(True), 2, 40.0)
    job = SkimJob(HARD, ["channel", "k", "n_hard", "w2"], envelope=envelope, replaced={"two hard"})
    path = f"{shared_dir(spark)}/skim-{uuid.uuid4().hex}"
    snapshot(job.rows(ev), f"{path}/events", job.columns, ["channel"])
    snapshot(ledger(ev, ["channel"], "w"), f"{path}/ledger", ["channel", "n_rows", "sum_w"])
    kept = spark.read.parquet(f"{path}/events").groupBy("channel").agg(
        F.count("k").alias("n_kept"), F.count_if(F.col("n_hard") >= 2).alias("n_nominal"), F.sum("w2").alias("sum_w2")
    )
    total = spark.read.parquet(f"{path}/ledger").join(kept, "channel", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return total.select("channel", "n_rows", r("sum_w").alias("sum_w"), zero("n_kept"), zero("n_nominal"), r(F.coalesce("sum_w2", F.lit(0.0))).alias("sum_w2"))


@query(
    f"""WITH {SQL_EV} SELECT k, round(w, 9) AS w, channel, era, round(w * 2, 9) AS w2, era - 1990 AS age FROM ev"""
)
def added_columns(spark, sf):
    """Add a fixed set of derived columns, keep everything else."""
    steps = S.StepList([("define", "w2", "w * 2"), ("define", "age", "era - 1990")])
    ev = S.apply_steps(heads(spark, sf, "w", "channel", "era"), steps)
    return ev.withColumns({"w": r("w", 9), "w2": r("w2", 9)})
