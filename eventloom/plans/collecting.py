"""Whole collect jobs: weights, shifts, one and two dimensions, channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators.scale import values_table
from eventloom.operators.steps import StepList
from eventloom.plans.collect import CollectJob, ShiftSource, Variable, WeightSource, collect
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, events, r, sql_bin, sql_edges, table

PT_EDGES = (10.0, 25.0, 40.0, 55.0, 70.0, 100.0)
BINNINGS = {
    "pt": {"nBins": "5", "binning": PT_EDGES},
    "lead": {"nBins": 12, "min": 20, "max": "80"},
    "mass": {"nBins": 4, "min": 0, "max": 5},
}
ALIASES = {"TAG": ["btag_hf", "btag_lf"]}
CONFIG = {
    "datasets": ["old", "NO", "RO", "new"],
    "needMerge": {"old": ["AF", "RF"], "new": ["NF", "AO"]},
    "MCweight": ["w", "btag_weight", "JVMweight"],
    "varNames": ["pt", "lead"],
    "varNames_2D": [["lead", "mass"]],
    "weightSyst": {"TAG": "btag_weight", "CMS_trig": "JVMweight", "other": "pu_weight"},
    "shiftSyst": {"rel": ["pt"], "res": ["pt", "mass"], "lost": ["pt"]},
    "shiftWeightSyst": {"rel": ["btag_weight"]},
}
STEPS = StepList([("cut", "pt", "pt > 25"), ("define", "lead", "pt + mass"), ("cut", "lead-range", "lead > 30 AND lead - mass < 95")])
FACTORS = [("AF", 2.0), ("NO", 0.5), ("NF", 1.25)]


def _job() -> CollectJob:
    return CollectJob.from_config(CONFIG, STEPS, BINNINGS, ALIASES, {"res": "corr"}, selected=["old", "NO", "new"])


def _lines(spark, sf):
    """Lines as events; the columns of ``btag_lf`` and of ``lost`` are not stored."""
    li = table(spark, sf, "lineitem")
    tag = F.expr("1 + l_discount")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("channel"),
        F.expr("l_extendedprice / 1000D").alias("pt"),
        F.expr("l_quantity / 10D").alias("mass"),
        F.col("l_tax").alias("rel"),
        F.expr("1 + l_linenumber / 50D").alias("corr"),
        F.expr("1 + l_linenumber / 40D").alias("corr_up"),
        F.expr("1 + l_linenumber / 80D").alias("corr_down"),
        F.sqrt("l_quantity").alias("w"),
        tag.alias("btag_weight"),
        (tag * 1.1).alias("btag_weight_hf_up"),
        (tag * 0.85).alias("btag_weight_hf_down"),
        (tag + 0.2).alias("btag_weight_rel_up"),
        (tag - 0.2).alias("btag_weight_rel_down"),
        F.expr("1 - l_tax").alias("JVMweight"),
        F.expr("1 - l_tax / 2").alias("JVMweight_trig_up"),
        F.expr("1 - l_tax * 2").alias("JVMweight_trig_down"),
    )


_SQL_VARIED = [
    # variation, pt, mass, weights by name
    ("", "pt", "mass", {"": "tag * jvm", "_btag_hf_up": "tag * 1.1::DOUBLE * jvm", "_btag_hf_down": "tag * 0.85::DOUBLE * jvm", "_CMS_trig_up": "tag * (1 - rel / 2)", "_CMS_trig_down": "tag * (1 - rel * 2)"}),
    ("_rel_up", "pt * (1 + rel)", "mass", {"_rel_up": "(tag + 0.2::DOUBLE) * jvm"}),
    ("_rel_down", "pt * (1 - rel)", "mass", {"_rel_down": "(tag - 0.2::DOUBLE) * jvm"}),
    ("_res_up", "pt / (1 + i / 50) * (1 + i / 40)", "mass / (1 + i / 50) * (1 + i / 40)", {"_res_up": "tag * jvm"}),
    ("_res_down", "pt / (1 + i / 50) * (1 + i / 80)", "mass / (1 + i / 50) * (1 + i / 80)", {"_res_down": "tag * jvm"}),
]
SQL_LINES = "li AS (SELECT l_returnflag || l_linestatus AS channel, l_extendedprice / 1000 AS pt, l_quantity / 10 AS mass, l_tax AS rel, CAST(l_linenumber AS DOUBLE) AS i, sqrt(l_quantity) AS w, 1 + l_discount AS tag, 1 - l_tax AS jvm FROM lineitem)"
SQL_SELECTED = f"""WITH {SQL_LINES}, v AS (
  {" UNION ALL ".join(f"SELECT channel, 'MCTotalWeight{n}' AS weight, {pt} AS pt, {mass} AS mass, w * {x} AS w FROM li" for _, pt, mass, ws in _SQL_VARIED for n, x in ws.items())}),
s AS (SELECT *, pt + mass AS lead FROM v WHERE pt > 25 AND pt + mass > 30 AND pt + mass - mass < 95),
c AS (SELECT * FROM (VALUES (0, 'AF', 'old', 2.0::DOUBLE), (1, 'RF', 'old', 1.0), (2, 'NO', '', 0.5), (3, 'NF', 'new', 1.25), (4, 'AO', 'new', 1.0)) t(place, channel, sample, f))"""
_IX_PT = f"least(greatest({sql_edges('pt', PT_EDGES)}, 1), 5)"
_IX_LEAD = f"least(greatest({sql_bin('lead', 12, 20.0, 80.0)}, 1), 12)"
_IX_MASS = f"least(greatest({sql_bin('mass', 4, 0.0, 5.0)}, 1), 4)"


@query(
    SQL_SELECTED
    + ", b AS ("
    + " UNION ALL ".join(
        f"SELECT channel, weight, '{var}' AS var, CAST({ix} AS INTEGER) AS ix, CAST({iy} AS INTEGER) AS iy, sum(w) AS sumw, sum(w * w) AS sumw2, count(*) AS n FROM s GROUP BY ALL"
        for var, ix, iy in (("pt", _IX_PT, "NULL"), ("lead", _IX_LEAD, "NULL"), ("lead_vs_mass", _IX_LEAD, _IX_MASS))
    )
    + ") SELECT CAST(place AS INTEGER) AS place, channel, sample, weight, var, ix, iy, round(sumw * f, 5) AS sumw, round(sumw2 * f * f, 4) AS sumw2, n FROM b JOIN c USING (channel)"
)
def collect_whole_job(spark, sf):
    """Five channels, two usable weight sources, two usable shifts (one with its own
    weight), one and two dimensions, folded and scaled: one scan, one exchange."""
    factor = values_table(spark, "channel string, factor double", FACTORS)
    hist, _ = collect(_lines(spark, sf), _job(), factor=factor)
    return hist.select("place", "channel", "sample", "weight", "var", "ix", "iy", r("sumw", 5).alias("sumw"), r("sumw2", 4).alias("sumw2"), "n")


@query(
    SQL_SELECTED
    + """, n AS (SELECT weight, count(*) AS n FROM s JOIN c USING (channel) GROUP BY weight),
rep AS (SELECT * FROM (VALUES ('weight', 'btag_hf', ''), ('weight', 'btag_lf', 'missing btag_weight_lf_up, btag_weight_lf_down'), ('weight', 'CMS_trig', ''),
  ('weight', 'other', 'pu_weight is no factor of the weight'), ('shift', 'rel', ''), ('shift', 'res', ''), ('shift', 'lost', 'missing lost')) t(kind, source, reason),
  (VALUES ('up'), ('down')) d(direction))
SELECT kind, source, direction, reason = '' AS used, reason, coalesce(n, 0) AS n FROM rep LEFT JOIN n ON weight = 'MCTotalWeight_' || source || '_' || direction"""
)
def collect_job_report(spark, sf):
    """Which variations of a job were used, with their selected events, and why the
    others were skipped."""
    hist, report = collect(_lines(spark, sf), _job())
    filled = hist.where("var = 'pt'").groupBy("weight").agg(F.sum("n").alias("n"))
    named = F.concat(F.lit("MCTotalWeight_"), "source", F.lit("_"), "direction")
    return report.join(filled, named == F.col("weight"), "left").select("kind", "source", "direction", "used", "reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_OBJ_STEPS = StepList([("define", "n_hard", "CAST(size(filter(obj, o -> o.pt > 30)) AS DOUBLE)"), ("cut", "hard", "n_hard >= 1"), ("define", "lead", "array_max(transform(obj, o -> o.pt))"), ("cut", "lead-high", "lead > 60")])
_OBJ_SHIFTS = {"nominal": "pt", "rel_up": "pt * (1 + rel)", "rel_down": "pt * (1 - rel)", "res_up": "pt / score1 * (score1 + 0.1::DOUBLE)", "res_down": "pt / score1 * (score1 - 0.1::DOUBLE)"}


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, o AS (SELECT obj.*, 1 + score AS score1, ev.channel, ev.w, 1 + ev.w AS sf FROM obj JOIN ev USING (k)),
v AS ({" UNION ALL ".join(f"SELECT k, channel, '{n}' AS variation, any_value(w * sf{' * 2' if n == 'rel_up' else ' / 2' if n == 'rel_down' else ''}) AS w, CAST(sum(CASE WHEN {x} > 30 THEN 1 ELSE 0 END) AS DOUBLE) AS n_hard, max({x}) AS lead FROM o WHERE channel IN ('1-URGENT', '5-LOW') GROUP BY k, channel" for n, x in _OBJ_SHIFTS.items())}),
u AS (SELECT * FROM v UNION ALL SELECT k, channel, 'sf_up', w * 1.5, n_hard, lead FROM v WHERE variation = 'nominal' UNION ALL SELECT k, channel, 'sf_down', w * 0.5, n_hard, lead FROM v WHERE variation = 'nominal'),
s AS (SELECT channel, CASE WHEN variation = 'nominal' THEN 'DDTotalWeight' ELSE 'DDTotalWeight_' || variation END AS weight, w, n_hard, lead FROM u WHERE n_hard >= 1 AND lead > 60)
SELECT channel, weight, 'n_hard' AS var, {sql_bin('n_hard', 10, 0.0, 10.0)} AS ix, CAST(NULL AS INTEGER) AS iy, round(sum(w), 6) AS sumw, round(sum(w * w), 5) AS sumw2, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT channel, weight, 'lead_vs_n_hard', {sql_bin('lead', 16, 40.0, 120.0)}, {sql_bin('n_hard', 10, 0.0, 10.0)}, round(sum(w), 6), round(sum(w * w), 5), count(*) FROM s GROUP BY ALL"""
)
def collect_job_of_collections(spark, sf):
    """A job whose shifts act on a field of a collection, flow bins kept."""
    ev = events(spark, sf, ["pt", "rel", "score"], ["channel", "w"]).filter(F.size("obj") > 0)
    res = lambda o: (o["score"] + 1.0)
    ev = ev.withColumn("obj", F.transform("obj", lambda o: F.struct(o["pt"].alias("pt"), o["rel"].alias("rel"), res(o).alias("res"), (res(o) + 0.1).alias("res_up"), (res(o) - 0.1).alias("res_down"))))
    sf_ = F.col("w") + 1.0
    ev = ev.withColumns({"sf": sf_, "sf_up": sf_ * 1.5, "sf_down": sf_ * 0.5, "sf_high": sf_ * 2.0, "sf_low": sf_ / 2.0})
    lead, n = Axis("lead", 16, 40.0, 120.0), Axis("n_hard", 10, 0.0, 10.0)
    job = CollectJob(
        [("1-URGENT", ""), ("5-LOW", "")],
        [Variable(n), Variable(lead, n)],
        _OBJ_STEPS,
        ("w", "sf"),
        "DDTotalWeight",
        [WeightSource("sf", "sf")],
        [ShiftSource("rel", ("obj.pt",), weights=("sf", "sf_high", "sf_low")), ShiftSource("res", ("obj.pt",), ratio="res")],
        fold=False,
    )
    hist, _ = collect(ev, job)
    return hist.select("channel", "weight", "var", "ix", "iy", r("sumw", 6).alias("sumw"), r("sumw2", 5).alias("sumw2"), "n")
