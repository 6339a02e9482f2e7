"""Histogram fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators import histogram as H
from eventloom.operators import variations as X
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, flat_events, heads, events, objects, r, sql_bin, sql_edges

EDGES = (0.0, 5.0, 10.0, 20.0, 40.0, 70.0, 90.0)
W = Axis("w", 25, 0.0, 5.0)
PT = Axis("pt", 12, 10.0, 70.0)
PT_VAR = Axis("pt", edges=EDGES)
ETA = Axis("eta", 8, -2.0, 2.0)


def _out(hist, *keys, d=9, d2=6):
    return hist.select(*keys, r("sumw", d).alias("sumw"), r("sumw2", d2).alias("sumw2"), "n")


@query(f"""WITH {SQL_EV} SELECT status, count(*) AS n, round(sum(w), 9) AS sum_w FROM ev GROUP BY status""")
def sums_and_counts(spark, sf):
    return heads(spark, sf, "status", "w").groupBy("status").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w"), 9).alias("sum_w"))


@query(
    f"""WITH {SQL_EV} SELECT channel, {sql_bin('w', 25, 0.0, 5.0)} AS ix, round(sum(w), 9) AS sumw, round(sum(w * w), 6) AS sumw2, count(*) AS n FROM ev GROUP BY 1, 2"""
)
def histogram_fixed(spark, sf):
    """Fixed bins: sum of weights and of squared weights per bin, flow kept."""
    return _out(H.fill(heads(spark, sf, "channel", "w"), [W], F.col("w"), ["channel"]), "channel", "ix")


@query(
    f"""SELECT {sql_edges('l_extendedprice / 1000', EDGES)} AS ix, round(sum(l_quantity), 6) AS sumw, round(sum(l_quantity * l_quantity), 6) AS sumw2, count(*) AS n,
  any_value(lo) AS x_lo FROM lineitem LEFT JOIN (VALUES (1, 0.0::DOUBLE), (2, 5.0), (3, 10.0), (4, 20.0), (5, 40.0), (6, 70.0), (7, 90.0)) e(b, lo)
  ON b = {sql_edges('l_extendedprice / 1000', EDGES)} GROUP BY 1"""
)
def histogram_variable(spark, sf):
    """Variable-width bins with their lower edge."""
    hist = H.fill(objects(spark, sf, "pt", raw=["l_quantity"]), [PT_VAR], F.col("l_quantity"))
    return _out(H.with_edges(hist, PT_VAR), "ix", "x_lo", d=6)


@query(
    f"""WITH {SQL_OBJ} SELECT {sql_edges('pt', EDGES)} AS ix, {sql_bin('eta', 8, -2.0, 2.0)} AS iy, round(sum(mass), 6) AS sumw, round(sum(mass * mass), 6) AS sumw2, count(*) AS n FROM obj GROUP BY 1, 2"""
)
def histogram_2d(spark, sf):
    """Two axes, one variable and one fixed."""
    return _out(H.fill(objects(spark, sf, "pt", "eta", "mass"), [PT_VAR, ETA], F.col("mass")), "ix", "iy", d=6)


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV} SELECT {sql_bin('pt', 12, 10.0, 70.0)} AS ix, round(sum(w), 9) AS sumw, round(sum(w * w), 6) AS sumw2, count(*) AS n
FROM obj JOIN ev USING (k) WHERE score >= 0.3 GROUP BY 1"""
)
def histogram_of_array(spark, sf):
    """Every selected object fills with the weight of its event."""
    ev = events(spark, sf, ["pt", "score"], ["w"])
    return _out(H.fill_array(ev, F.filter("obj", lambda o: o["score"] >= 0.3), ["pt"], [PT], F.col("w")), "ix")


@query(
    f"""WITH {SQL_OBJ}, q AS (SELECT pt, row_number() OVER (ORDER BY pt) AS lo_rank, row_number() OVER (ORDER BY pt DESC) AS hi_rank, greatest(1, count(*) OVER () // 100) AS kk FROM obj)
SELECT 'full' AS mode, round(min(pt), 9) AS lo, round(max(pt), 9) AS hi FROM q
UNION ALL SELECT 'low', round(max(CASE WHEN lo_rank = kk THEN pt END), 9), round(max(pt), 9) FROM q
UNION ALL SELECT 'both', round(max(CASE WHEN lo_rank = kk THEN pt END), 9), round(max(CASE WHEN hi_rank = kk THEN pt END), 9) FROM q"""
)
def automatic_range(spark, sf):
    """Range from the data, whole or without the outer percent (exact)."""
    from eventloom.operators.scale import values_table

    o = objects(spark, sf, "pt")
    modes = {"full": (False, False), "low": (True, False), "both": (True, True)}
    rows = [(m, round(lo, 9), round(hi, 9)) for m, (lo, hi) in H.value_ranges(o, "pt", modes).items()]
    return values_table(spark, "mode string, lo double, hi double", rows)


@query(
    f"""WITH {SQL_EV}, b AS (SELECT {sql_bin('w', 10, 0.0, 5.0)} AS ix, w, w * 1.1::DOUBLE AS up, w * 0.9::DOUBLE AS down FROM ev)
SELECT 'nominal' AS weight, ix, round(sum(w), 9) AS sumw, round(sum(w * w), 6) AS sumw2, count(*) AS n FROM b GROUP BY ix
UNION ALL SELECT 'up', ix, round(sum(up), 9), round(sum(up * up), 6), count(*) FROM b GROUP BY ix
UNION ALL SELECT 'down', ix, round(sum(down), 9), round(sum(down * down), 6), count(*) FROM b GROUP BY ix"""
)
def histogram_many_weights(spark, sf):
    """Nominal and weight variations of one selection in a single pass."""
    ev = heads(spark, sf, "w").withColumns({"f": F.lit(1.0), "f_sys_up": F.lit(1.1), "f_sys_down": F.lit(0.9)})
    weights = {
        "nominal": X.weight_product(["w", "f"]),
        "up": X.weight_product(["w", "f"], {"f": X.shifted_weight_name("f", "sys", "up")}),
        "down": X.weight_product(["w", "f"], {"f": X.shifted_weight_name("f", "sys", "down")}),
    }
    return _out(H.fill_weights(ev, [Axis("w", 10, 0.0, 5.0)], weights), "weight", "ix")


@query(
    f"""WITH {SQL_EV}, b AS (SELECT {sql_bin('w', 10, 0.0, 5.0)} AS ix, w FROM ev), s AS (SELECT range AS j FROM range(40))
SELECT 'v' || CAST(j AS VARCHAR) AS weight, ix, round(sum(w * (1 + j / 100.0::DOUBLE)), 9) AS sumw, round(sum(w * w * (1 + j / 100.0::DOUBLE) * (1 + j / 100.0::DOUBLE)), 6) AS sumw2, count(*) AS n FROM b CROSS JOIN s GROUP BY j, ix"""
)
def histogram_weight_list(spark, sf):
    """More weights than fit a wide aggregation: a weight list per row."""
    ev = heads(spark, sf, "w")
    weights = {f"v{j}": F.col("w") * F.lit(1 + j / 100.0) for j in range(40)}
    return _out(H.fill_weights(ev, [Axis("w", 10, 0.0, 5.0)], weights), "weight", "ix")


def _sql_shift(name, factor, cut):
    return f"""SELECT '{name}' AS variation, {sql_bin(f'pt * {factor}', 12, 10.0, 70.0)} AS ix,
  round(sum(CASE WHEN {cut} THEN w ELSE 0.0::DOUBLE END), 9) AS sumw, round(sum(CASE WHEN {cut} THEN w * w ELSE 0.0::DOUBLE END), 6) AS sumw2,
  CAST(sum(CASE WHEN {cut} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM b GROUP BY 2"""


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, b AS (SELECT pt, rel, w FROM obj JOIN ev USING (k))
{_sql_shift('nominal', '1.0', 'pt > 20')} UNION ALL {_sql_shift('up', '(1 + rel)', 'pt * (1 + rel) > 20')} UNION ALL {_sql_shift('down', '(1 - rel)', 'pt * (1 - rel) > 20')}"""
)
def histogram_shifts(spark, sf):
    """Shifted variables, each with its own pass flag and weight, in one scan."""
    ev = flat_events(spark, sf, ["pt", "rel"], ["w"])
    pt = F.col("pt")
    up = X.shifted_value(pt, "up", F.col("rel"))
    down = X.shifted_value(pt, "down", corr=F.lit(1.0), corr_shifted=1.0 - F.col("rel"))
    shifts = [H.Shift(n, v, v > 20, F.col("w")) for n, v in (("nominal", pt), ("up", up), ("down", down))]
    return _out(H.fill_shifts(ev, PT, shifts), "variation", "ix")


@query(
    f"""WITH {SQL_OBJ} SELECT 'pt' AS var, {sql_bin('pt', 12, 10.0, 70.0)} AS ix, round(sum(mass), 6) AS sumw, round(sum(mass * mass), 6) AS sumw2, count(*) AS n FROM obj GROUP BY 2
UNION ALL SELECT 'eta', {sql_bin('eta', 8, -2.0, 2.0)}, round(sum(mass), 6), round(sum(mass * mass), 6), count(*) FROM obj GROUP BY 2
UNION ALL SELECT 'score', {sql_bin('score', 5, 0.0, 1.0)}, round(sum(mass), 6), round(sum(mass * mass), 6), count(*) FROM obj GROUP BY 2"""
)
def histogram_many_variables(spark, sf):
    """All variables of a job in one scan, binning from a configuration."""
    axes = [PT, ETA, Axis.from_config("score", {"nBins": "5", "min": "0", "max": "1", "label": "score"})]
    return _out(H.fill_variables(objects(spark, sf, "pt", "eta", "score", "mass"), axes, F.col("mass")), "var", "ix", d=6)


@query(
    f"""WITH {SQL_OBJ}, b AS (SELECT least(greatest({sql_edges('pt', EDGES)}, 1), 6) AS ix, least(greatest({sql_bin('eta', 8, -2.0, 2.0)}, 1), 8) AS iy, mass FROM obj)
SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(sum(mass), 6) AS sumw, round(sum(mass * mass), 6) AS sumw2, count(*) AS n FROM b GROUP BY 1, 2"""
)
def folded_flow(spark, sf):
    """Flow bins folded into the visible edge bins of both axes."""
    hist = H.fill(objects(spark, sf, "pt", "eta", "mass"), [PT_VAR, ETA], F.col("mass"))
    return _out(H.fold_flow(hist, [], PT_VAR.n, ETA.n), "ix", "iy", d=6)


SQL_XSEC = "(VALUES ('1-URGENT', 0.5::DOUBLE), ('2-HIGH', 1.25::DOUBLE), ('3-MEDIUM', 2.0::DOUBLE), ('4-NOT SPECIFIED', 3.5::DOUBLE), ('5-LOW', 0.1::DOUBLE)) x(channel, xsec)"


@query(
    f"""WITH {SQL_EV}, t AS (SELECT channel, sum(w) AS total FROM ev GROUP BY channel),
h AS (SELECT channel, {sql_bin('w', 25, 0.0, 5.0)} AS ix, sum(w) AS s, sum(w * w) AS s2, count(*) AS n FROM ev WHERE w > 0.5 GROUP BY 1, 2)
SELECT h.channel, ix, round(s * (17.5 * xsec * 1000 / total), 4) AS sumw, round(s2 * (17.5 * xsec * 1000 / total) * (17.5 * xsec * 1000 / total), 4) AS sumw2, n
FROM h JOIN t USING (channel) JOIN {SQL_XSEC} USING (channel)"""
)
def normalised_to_luminosity(spark, sf):
    """Histograms scaled by lumi * cross-section * 1000 / sum of weights before cuts."""
    from eventloom.operators.scale import values_table
    from eventloom.operators.weights import mc_scale

    ev = heads(spark, sf, "channel", "w")
    total = ev.groupBy("channel").agg(F.sum("w").alias("total"))
    xsec = values_table(
        spark, "channel string, xsec double", [("1-URGENT", 0.5), ("2-HIGH", 1.25), ("3-MEDIUM", 2.0), ("4-NOT SPECIFIED", 3.5), ("5-LOW", 0.1)]
    )
    hist = H.fill(ev.filter("w > 0.5"), [W], F.col("w"), ["channel"])
    factors = total.join(xsec, "channel").select("channel", mc_scale(F.lit(17.5), F.col("xsec"), F.col("total")).alias("f"))
    return _out(H.scale(hist.join(factors, "channel"), F.col("f")), "channel", "ix", d=4, d2=4)


@query(
    """WITH d AS (SELECT channel, CASE WHEN status = 'F' THEN 'one' WHEN status = 'O' THEN 'MCTotalWeight' ELSE 'DDTotalWeight' END AS weight,
  CASE WHEN status = 'F' THEN 1.0::DOUBLE WHEN status = 'O' THEN w ELSE w * 0.5 END AS v FROM (SELECT o_orderpriority AS channel, o_orderstatus AS status, o_totalprice / 100000 AS w FROM orders))
SELECT channel, weight, count(*) AS n, round(sum(v), 9) AS sumw FROM d GROUP BY channel, weight"""
)
def weights_by_job_type(spark, sf):
    """Simulation, data-driven and data channels use different weight sets."""
    from eventloom.plans.jobs import JobType

    ev = heads(spark, sf, "channel", "status", "w").withColumn("transfer", F.lit(0.5))
    kinds = {"F": JobType.DATA, "O": JobType.MC, "P": JobType.DATA_DRIVEN}
    name = value = None
    for status, kind in kinds.items():
        cond = F.col("status") == status
        w = kind.weight(mc=["w"], dd=["w", "transfer"])
        name = F.when(cond, kind.value) if name is None else name.when(cond, kind.value)
        value = F.when(cond, w) if value is None else value.when(cond, w)
    ev = ev.select("channel", name.alias("weight"), value.alias("v"))
    return ev.groupBy("channel", "weight").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 9).alias("sumw"))


@query(
    f"""WITH {SQL_EV} SELECT 'rel' AS variation, count(*) AS n, TRUE AS used, '' AS reason FROM ev
UNION ALL SELECT 'w_sys', count(*), FALSE, 'missing w_sys_up, w_sys_down' FROM ev"""
)
def variation_validity(spark, sf):
    """Variations without their columns are skipped with a reason."""
    ev = heads(spark, sf, "w").withColumn("rel", F.lit(0.1))
    wanted = [X.Variation("rel", ("w",), "shift"), X.Variation("sys", ("w",))]
    good, rep = X.usable(spark, ev.columns, wanted)
    assert [v.source for v in good] == ["rel"]
    named = rep.select(F.when(F.col("variation") == "sys", "w_sys").otherwise(F.col("variation")).alias("variation"), "used", "reason")
    return named.withColumn("n", ev.agg(F.count(F.lit(1))).scalar())


@query(
    f"""WITH {SQL_EV}, c AS (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) AS kk FROM ev),
q AS (SELECT k, w, row_number() OVER (ORDER BY k) AS rn FROM ev) SELECT k, round(w, 9) AS w FROM q, c WHERE rn <= kk"""
)
def first_fraction(spark, sf):
    """First five percent of the events in key order (the sampling option)."""
    from eventloom.plans.jobs import first_fraction as first

    return first(heads(spark, sf, "w"), 0.05, ["k"]).withColumn("w", r("w", 9))


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, c AS (SELECT obj.*, ev.channel, ev.w FROM obj JOIN ev USING (k)),
v AS (SELECT k, channel, w, 'nominal' AS variation, CAST(sum(CASE WHEN pt > 30 THEN 1 ELSE 0 END) AS DOUBLE) AS n_hard, max(pt) AS lead FROM c GROUP BY ALL
  UNION ALL SELECT k, channel, w, 'up', CAST(sum(CASE WHEN pt * (1 + rel) > 30 THEN 1 ELSE 0 END) AS DOUBLE), max(pt * (1 + rel)) FROM c GROUP BY ALL
  UNION ALL SELECT k, channel, w, 'down', CAST(sum(CASE WHEN pt * (1 - rel) > 30 THEN 1 ELSE 0 END) AS DOUBLE), max(pt * (1 - rel)) FROM c GROUP BY ALL),
s AS (SELECT * FROM v WHERE n_hard >= 1 AND lead > 60)
SELECT channel, variation, 'n_hard' AS var, {sql_bin('n_hard', 10, 0.0, 10.0)} AS ix, round(sum(w), 9) AS sumw, round(sum(w * w), 6) AS sumw2, count(*) AS n FROM s GROUP BY 1, 2, 4
UNION ALL SELECT channel, variation, 'lead', {sql_bin('lead', 16, 40.0, 120.0)}, round(sum(w), 9), round(sum(w * w), 6), count(*) FROM s GROUP BY 1, 2, 4"""
)
def collect_with_shifts(spark, sf):
    """A whole collect job: all variables and variations of all channels, one scan."""
    from eventloom.plans.jobs import collect_job
    from eventloom.plans.selection import VARIED, _shifted_obj

    ev = _shifted_obj(events(spark, sf, ["pt", "rel"], ["channel", "w"]).filter(F.size("obj") > 0))
    axes = [Axis("n_hard", 10, 0.0, 10.0), Axis("lead", 16, 40.0, 120.0)]
    hist = collect_job(ev, VARIED, axes, F.col("w"), ["channel"], {"_up": {"obj": "obj_up"}, "_down": {"obj": "obj_down"}})
    return _out(hist, "channel", "variation", "var", "ix")
