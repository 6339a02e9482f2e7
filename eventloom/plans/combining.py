"""Histogram algebra: merging, ratios, bands, subtraction, templates, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.binning import Axis, equal_width_position
from eventloom.operators import fit as T
from eventloom.operators import histalgebra as A
from eventloom.operators import histogram as H
from eventloom.operators.scale import written
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, flat_events, heads, objects, r, sql_bin

W = Axis("w", 10, 0.0, 5.0)
WIDE_EDGES = [0.0, 10.0, 20.0, 40.0, 70.0, 100.0]

SQL_H = f"""WITH {SQL_EV}, h AS (SELECT channel, era, {sql_bin('w', 10, 0.0, 5.0)} AS ix, sum(w) AS sumw, sum(w * w) AS sumw2, count(*) AS n FROM ev GROUP BY 1, 2, 3)"""


def channel_hist(spark, sf, *keys, weight="w"):
    return H.fill(heads(spark, sf, *keys, "w"), [W], F.col(weight), keys)


def _out(hist, *keys, d=9, d2=6, n=True):
    return hist.select(*keys, r("sumw", d).alias("sumw"), r("sumw2", d2).alias("sumw2"), *(["n"] if n else []))


MERGED = {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow", "4-NOT SPECIFIED": "slow"}
SQL_MERGED = "CASE WHEN channel IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN channel IN ('5-LOW', '4-NOT SPECIFIED') THEN 'slow' ELSE channel END"


@query(f"""{SQL_H} SELECT {SQL_MERGED} AS channel, era, ix, round(sum(sumw), 9) AS sumw, round(sum(sumw2), 6) AS sumw2, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2, 3""")
def merged_channels(spark, sf):
    """Component channels merged under a common binning, which is checked."""
    hist = H.with_edges(channel_hist(spark, sf, "channel", "era"), W)
    return _out(A.merge(hist, MERGED, ["era", "ix"], edges=("x_lo", "x_hi")), "channel", "era", "ix")


@query(
    f"""{SQL_H}, p AS (SELECT DISTINCT channel, ix, era < 1998 AS early FROM h WHERE ix >= 1), b AS (SELECT channel, ix FROM p GROUP BY 1, 2 HAVING count(*) = 2)
SELECT channel, count(*) AS conflicts FROM b GROUP BY channel"""
)
def binning_check(spark, sf):
    """Groups whose histograms do not share one binning."""
    hist = H.with_edges(channel_hist(spark, sf, "channel", "era"), W)
    moved = hist.withColumn("x_lo", F.when(F.col("era") < 1998, F.col("x_lo")).otherwise(F.col("x_lo") + 0.25))
    return A.check_same_binning(moved, ["channel"])


@query(
    f"""{SQL_H} SELECT channel, ix, round(sum(CASE WHEN era < 1998 THEN sumw ELSE 2 * sumw END), 9) AS sumw, round(sum(CASE WHEN era < 1998 THEN sumw2 ELSE 4 * sumw2 END), 6) AS sumw2, CAST(sum(n) AS BIGINT) AS n
FROM h GROUP BY 1, 2"""
)
def added_sets(spark, sf):
    """Two histogram sets added key by key, one of them scaled."""
    hist = channel_hist(spark, sf, "channel", "era")
    parts = [hist.filter("era < 1998"), H.scale(hist.filter("era >= 1998"), F.lit(2.0))]
    return _out(A.add(parts, ["channel", "ix"]), "channel", "ix")


@query(f"""{SQL_H} SELECT channel, era, CAST(ix - 2 AS INTEGER) AS ix, round(sumw, 9) AS sumw, round(sumw2, 6) AS sumw2, n FROM h WHERE ix BETWEEN 3 AND 8""")
def cropped(spark, sf):
    """Bins fully inside a range, numbered again."""
    return _out(A.crop(channel_hist(spark, sf, "channel", "era"), W, 0.8, 4.2), "channel", "era", "ix")


@query(
    f"""{SQL_H}, s AS (SELECT era, ix, coalesce(sum(sumw) FILTER (channel = '1-URGENT'), 0) AS a, coalesce(sum(sumw2) FILTER (channel = '1-URGENT'), 0) AS va,
  coalesce(sum(sumw) FILTER (channel = '5-LOW'), 0) AS b, coalesce(sum(sumw2) FILTER (channel = '5-LOW'), 0) AS vb FROM h GROUP BY era, ix),
t AS (SELECT *, sum(a) OVER (PARTITION BY era) AS ta, sum(b) OVER (PARTITION BY era) AS tb FROM s)
SELECT 'plain' AS mode, era, ix, round(CASE WHEN b = 0 THEN 0 ELSE a / b END, 6) AS ratio, round(CASE WHEN b = 0 THEN 0 ELSE sqrt(va * b * b + vb * a * a) / (b * b) END, 6) AS error FROM t
UNION ALL SELECT 'shape', era, ix, round(CASE WHEN b = 0 THEN 0 ELSE a / ta / (b / tb) END, 6), round(CASE WHEN b = 0 THEN 0 ELSE sqrt(va * b * b + vb * a * a) / (b * b) * tb / ta END, 6) FROM t"""
)
def ratios(spark, sf):
    """Bin-wise ratio with errors, plain and of unit-normalised shapes."""
    hist = channel_hist(spark, sf, "channel", "era")
    num, den = F.col("channel") == "1-URGENT", F.col("channel") == "5-LOW"
    plain = A.ratio(hist, ["era", "ix"], num, den).withColumn("mode", F.lit("plain"))
    shape = A.ratio(hist, ["era", "ix"], num, den, shapes=True).withColumn("mode", F.lit("shape"))
    return plain.unionByName(shape).select("mode", "era", "ix", r("ratio").alias("ratio"), r("error").alias("error"))


@query(f"""{SQL_H}, t AS (SELECT channel, ix, sum(sumw) AS s FROM h GROUP BY 1, 2) SELECT channel, ix, round(s / sum(CASE WHEN ix BETWEEN 1 AND 10 THEN s END) OVER (PARTITION BY channel), 6) AS sumw FROM t""")
def unit_shapes(spark, sf):
    """Unit normalisation over the visible bins."""
    return A.normalise(channel_hist(spark, sf, "channel"), ["channel"], W.n).select("channel", "ix", r("sumw").alias("sumw"))


ROLES = {"1-URGENT": "signal", "2-HIGH": "stack", "3-MEDIUM": "stack", "4-NOT SPECIFIED": "data_driven", "5-LOW": "data"}
ERA_LUMI = {1992: 4.0, 1993: 5.0, 1994: 6.0, 1995: 3.5, 1996: 2.5, 1997: 4.5, 1998: 1.5}
MEASURED, SIMULATED, SIGNAL = [1992, 1993, 1994, 1995, 1996, 1997, 1998], [1994, 1995, 1996], [1993, 1997]


@query(
    f"""{SQL_H}, l(era, lumi) AS (VALUES {", ".join(f"({e}, {v}::DOUBLE)" for e, v in ERA_LUMI.items())}),
t AS (SELECT sum(lumi) AS target, sum(lumi) FILTER (era IN (1994, 1995, 1996)) AS mc, sum(lumi) FILTER (era IN (1993, 1997)) AS sig FROM l),
x AS (SELECT h.*, CASE channel WHEN '1-URGENT' THEN 'signal' WHEN '4-NOT SPECIFIED' THEN 'data_driven' WHEN '5-LOW' THEN 'data' ELSE 'stack' END AS role FROM h JOIN l USING (era)),
y AS (SELECT x.*, CASE role WHEN 'signal' THEN target / sig WHEN 'stack' THEN target / mc ELSE 1 END * CASE WHEN channel = '2-HIGH' THEN 1.5 ELSE 1 END AS f FROM x, t
  WHERE CASE role WHEN 'signal' THEN era IN (1993, 1997) WHEN 'stack' THEN era IN (1994, 1995, 1996) ELSE TRUE END)
SELECT role, ix, round(sum(sumw * f), 6) AS sumw, round(sum(sumw2 * f * f), 5) AS sumw2 FROM y GROUP BY 1, 2"""
)
def combined_eras(spark, sf):
    """Eras combined: simulation scaled to the luminosity of the data, by role."""
    hist = channel_hist(spark, sf, "channel", "era")
    eras = {"data": MEASURED, "data_driven": MEASURED, "stack": SIMULATED, "signal": SIGNAL}
    out = A.combine_eras(hist, ["ix"], ROLES, ERA_LUMI, eras, MEASURED, {"2-HIGH": 1.5})
    return out.select("role", "ix", r("sumw").alias("sumw"), r("sumw2", 5).alias("sumw2"))


@query(
    f"""WITH {SQL_EV}, f AS (SELECT channel, status, {sql_bin('w', 10, 0.0, 5.0)} AS ix, sum(w) AS sumw FROM ev WHERE NOT (channel = '3-MEDIUM' AND status = 'O') GROUP BY 1, 2, 3),
x AS (SELECT c.channel, v.variation, b.range AS ix FROM (SELECT DISTINCT channel FROM ev UNION SELECT 'absent') c, (VALUES ('F'), ('O')) v(variation), range(12) b)
SELECT x.channel, x.variation, CAST(x.ix AS INTEGER) AS ix, round(coalesce(CASE WHEN x.channel = '3-MEDIUM' AND x.variation = 'O' THEN n.sumw ELSE f.sumw END, 0), 9) AS sumw
FROM x LEFT JOIN f ON f.channel = x.channel AND f.status = x.variation AND f.ix = x.ix LEFT JOIN f n ON n.channel = x.channel AND n.status = 'F' AND n.ix = x.ix"""
)
def completed_set(spark, sf):
    """Missing variation -> nominal of the channel -> zero."""
    ev = heads(spark, sf, "channel", "status", "w").filter("status IN ('F', 'O') AND NOT (channel = '3-MEDIUM' AND status = 'O')")
    ev = ev.withColumn("variation", F.when(F.col("status") == "F", "nominal").otherwise("O"))
    hist = H.fill(ev, [W], F.col("w"), ["channel", "variation"])
    full = A.complete(hist, [*ROLES, "absent"], ["O"], W)
    name = F.when(F.col("variation") == "nominal", "F").otherwise(F.col("variation")).alias("variation")
    return full.select("channel", name, "ix", r("sumw", 9).alias("sumw"))


SQL_B = f"""WITH {SQL_OBJ}, {SQL_EV}, c AS (SELECT pt, rel, score, w FROM obj JOIN ev USING (k)),
v AS (
  SELECT 'nominal' AS source, '' AS direction, pt AS x, w FROM c UNION ALL SELECT 'rel', 'up', pt * (1 + rel), w FROM c UNION ALL SELECT 'rel', 'down', pt * (1 - rel), w FROM c
  UNION ALL SELECT 'wgt', 'up', pt, w * (1 + score / 5) FROM c UNION ALL SELECT 'wgt', 'down', pt, w * (1 - score / 10) FROM c),
stored AS (SELECT source, direction, {sql_bin('x', 12, 10.0, 70.0)} AS ix, sum(w) AS sumw, sum(w * w) AS sumw2 FROM v
  WHERE NOT (source = 'wgt' AND direction = 'up' AND x BETWEEN 20 AND 30) AND NOT (source = 'nominal' AND x BETWEEN 60 AND 65) GROUP BY 1, 2, 3),
h AS (SELECT k.source, k.direction, b.ix, coalesce(s.sumw, 0) AS sumw, coalesce(s.sumw2, 0) AS sumw2 FROM (SELECT DISTINCT source, direction FROM stored) k
  CROSS JOIN (SELECT DISTINCT ix FROM stored) b LEFT JOIN stored s ON s.source = k.source AND s.direction = k.direction AND s.ix = b.ix),
n AS (SELECT ix, sumw AS nom, sumw2 AS nom2 FROM h WHERE source = 'nominal')"""


def varied_set(spark, sf):
    """Nominal and two variations (value shift, weight shift) with directions."""
    ev = flat_events(spark, sf, ["pt", "rel", "score"], ["w"])
    pt, w, rel, s = (F.col(c) for c in ("pt", "w", "rel", "score"))
    ok = F.lit(True)
    # one side of a source and the nominal are empty in some bins
    shifts = [
        H.Shift("nominal|", pt, ~pt.between(60, 65), w),
        H.Shift("rel|up", pt * (1.0 + rel), ok, w),
        H.Shift("rel|down", pt * (1.0 - rel), ok, w),
        H.Shift("wgt|up", pt, ~pt.between(20, 30), w * (1.0 + s / 5.0)),
        H.Shift("wgt|down", pt, ok, w * (1.0 - s / 10.0)),
    ]
    hist = H.fill_shifts(ev, Axis("pt", 12, 10.0, 70.0), shifts)
    name = F.split("variation", r"\|")
    return hist.withColumns({"source": F.get(name, F.lit(0)), "direction": F.get(name, F.lit(1))})


@query(
    f"""{SQL_B}, s AS (SELECT h.source, n.ix, n.nom, n.nom2, max(sumw) FILTER (direction = 'up') - nom AS du, max(sumw) FILTER (direction = 'down') - nom AS dd FROM n JOIN h ON h.ix = n.ix AND h.source <> 'nominal' GROUP BY 1, 2, 3, 4)
SELECT ix, round(nom, 9) AS nominal, round(sqrt(sum(power(greatest(0::DOUBLE, du, dd), 2)) + nom2), 6) AS err_up, round(sqrt(sum(power(greatest(0::DOUBLE, -du, -dd), 2)) + nom2), 6) AS err_down,
  CASE WHEN nom = 0 THEN 0 ELSE round(sqrt(sum(power(greatest(0::DOUBLE, du, dd), 2)) + nom2) / nom, 6) END AS rel_up FROM s GROUP BY ix, nom, nom2"""
)
def uncertainty_band(spark, sf):
    """Quadrature band of all variation pairs with the statistical part; its ratio."""
    band = A.uncertainty_band(varied_set(spark, sf), ["ix"], statistical=True)
    rel = A.ratio_band(band).select("ix", r("err_up").alias("rel_up"))
    out = band.select("ix", r("nominal", 9).alias("nominal"), r("err_up").alias("err_up"), r("err_down").alias("err_down"))
    return out.join(rel, "ix")


@query(
    f"""{SQL_B} SELECT n.ix, round(nom, 9) AS nominal, round(nom + greatest(0, max(sumw - nom)), 6) AS upper, round(nom + least(0, min(sumw - nom)), 6) AS lower,
  round(sqrt(CASE WHEN max(sumw - nom) > 0 THEN arg_max(sumw2, sumw) ELSE nom2 END), 6) AS upper_error, round(sqrt(CASE WHEN min(sumw - nom) < 0 THEN arg_min(sumw2, sumw) ELSE nom2 END), 6) AS lower_error
  FROM n JOIN h USING (ix) GROUP BY n.ix, nom, nom2"""
)
def largest_variation(spark, sf):
    """Per bin the largest upward and the most downward variation."""
    out = A.max_variation(varied_set(spark, sf), ["ix"])
    return out.select("ix", r("nominal", 9).alias("nominal"), *[r(c).alias(c) for c in ("upper", "lower", "upper_error", "lower_error")])


FACTORS = {"1-URGENT": (0.9, 1.1), "2-HIGH": (0.8, 1.3)}


@query(
    f"""{SQL_H}, t AS (SELECT channel, ix, sum(sumw) AS s FROM h GROUP BY 1, 2),
f AS (SELECT ix, sum(s) AS nom, sum(s * CASE channel WHEN '1-URGENT' THEN 1.1 WHEN '2-HIGH' THEN 1.3 ELSE 1 END) AS up, sum(s * CASE channel WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.8 ELSE 1 END) AS down,
  sum(CASE WHEN channel = '5-LOW' THEN s * 1.4 ELSE s END) AS rup, sum(CASE WHEN channel = '5-LOW' THEN greatest(0, s * 0.6) ELSE s END) AS rdown FROM t GROUP BY ix)
SELECT ix, round(nom, 9) AS nominal, round(sqrt(power(greatest(0, up - nom, down - nom), 2) + power(greatest(0, rup - nom, rdown - nom), 2)), 6) AS err_up,
  round(sqrt(power(greatest(0, nom - up, nom - down), 2) + power(greatest(0, nom - rup, nom - rdown), 2)), 6) AS err_down FROM f"""
)
def normalisation_band(spark, sf):
    """Channel normalisation factors and a relative uncertainty of one channel."""
    hist = channel_hist(spark, sf, "channel")
    nominal = hist.groupBy("ix").agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2")).withColumns({"source": F.lit("nominal"), "direction": F.lit("")})
    factors = A.factor_variations(hist, ["ix"], FACTORS, "norm")
    rel = A.relative_variation(hist, "5-LOW", 0.4).groupBy("ix", "source", "direction").agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))
    cols = ["ix", "source", "direction", "sumw", "sumw2"]
    every = nominal.select(cols).unionByName(factors.select(cols)).unionByName(rel.select(cols))
    out = A.uncertainty_band(every, ["ix"])
    return out.select("ix", r("nominal", 9).alias("nominal"), r("err_up").alias("err_up"), r("err_down").alias("err_down"))


@query(
    f"""{SQL_H} SELECT channel, era, ix, round(sumw, 9) AS sumw, round(sumw2, 6) AS sumw2, n FROM h WHERE ix NOT IN (3, 4, 5)
UNION ALL SELECT s.channel, s.era, CAST(b.ix AS INTEGER), -1.0::DOUBLE, 0.0::DOUBLE, coalesce(h.n, 0) FROM (SELECT DISTINCT channel, era FROM h) s CROSS JOIN (VALUES (3), (4), (5)) b(ix)
  LEFT JOIN h ON h.channel = s.channel AND h.era = s.era AND h.ix = b.ix"""
)
def blinded(spark, sf):
    """Bins with their centre in a closed range are blinded."""
    return _out(A.blind(channel_hist(spark, sf, "channel", "era"), W, [(1.0, 1.8), (2.25, 2.3)], ["channel", "era"]), "channel", "era", "ix")


@query(
    f"""WITH {SQL_OBJ} SELECT k, i, round(CASE WHEN pt <= 0 THEN 0 WHEN pt >= 100 THEN 5 WHEN pt <= 10 THEN pt / 10 WHEN pt <= 20 THEN 1 + (pt - 10) / 10 WHEN pt <= 40 THEN 2 + (pt - 20) / 20 WHEN pt <= 70 THEN 3 + (pt - 40) / 30 ELSE 4 + (pt - 70) / 30 END, 9) AS x FROM obj"""
)
def equal_width_coordinate(spark, sf):
    """Coordinate on an axis with equally wide bins."""
    from eventloom.plans.tables import nested

    ev = nested(spark, sf, "pt")
    out = ev.select("k", F.posexplode_outer("obj").alias("i", "o"))
    return out.select("k", "i", r(equal_width_position(F.col("o.pt"), WIDE_EDGES), 9).alias("x"))


@query(
    f"""{SQL_H}, t AS (SELECT channel, sum(sumw) AS s FROM h WHERE ix BETWEEN 1 AND 10 GROUP BY channel HAVING sum(sumw) > 0.000001), m AS (SELECT max(s) AS top FROM t),
q AS (SELECT *, top * 37 / s AS ra FROM t, m)
SELECT channel, round(s, 9) AS integral, CAST(row_number() OVER (ORDER BY s, channel) AS INTEGER) AS position,
  CAST(CASE WHEN ra < 1 THEN 1 WHEN 5 * power(10, floor(log10(ra))) <= ra THEN 5 * power(10, floor(log10(ra))) WHEN 2 * power(10, floor(log10(ra))) <= ra THEN 2 * power(10, floor(log10(ra))) ELSE power(10, floor(log10(ra))) END AS INTEGER) AS scale FROM q"""
)
def stack_order_and_scale(spark, sf):
    """Channels ordered by integral with a display scale against the largest."""
    order = A.stack_order(channel_hist(spark, sf, "channel"), W.n)
    top = order.agg(F.max("integral")).scalar()
    return order.select(
        "channel", r("integral", 9).alias("integral"), "position", A.nice_scale(top * 37.0, F.col("integral")).alias("scale")
    )


@query(
    f"""{SQL_H}, m AS (SELECT min(sumw) FILTER (sumw > 0 AND ix BETWEEN 1 AND 10) AS s FROM h) SELECT round(coalesce(s, 0), 9) AS smallest, CASE WHEN s > 0 THEN power(10, floor(log10(s)) - 1) ELSE 0 END AS log_floor FROM m"""
)
def smallest_content(spark, sf):
    """Smallest positive content and the power of ten below it."""
    return A.smallest_positive(channel_hist(spark, sf, "channel", "era"), W.n).withColumn("smallest", r("smallest", 9))


@query(
    f"""{SQL_H} SELECT ix, round(sum(CASE WHEN channel IN ('1-URGENT', '2-HIGH') THEN sumw WHEN channel = '5-LOW' THEN -sumw END), 9) AS sumw, round(sum(CASE WHEN channel IN ('1-URGENT', '2-HIGH', '5-LOW') THEN sumw2 END), 6) AS sumw2,
  CAST(sum(n) FILTER (channel IN ('1-URGENT', '2-HIGH', '5-LOW')) AS BIGINT) AS n FROM h WHERE channel IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ix"""
)
def subtracted(spark, sf):
    """Data minus simulation with errors in quadrature."""
    c = F.col("channel")
    return _out(A.subtract(channel_hist(spark, sf, "channel", "era"), ["ix"], c.isin("1-URGENT", "2-HIGH"), c == "5-LOW"), "ix")


@query(
    f"""{SQL_H}, d AS (SELECT ix, sum(CASE WHEN era < 1998 THEN 1.5 * sumw ELSE -sumw END) AS s, sum(CASE WHEN era < 1998 THEN 2.25 * sumw2 ELSE sumw2 END) AS s2 FROM h GROUP BY ix)
SELECT ix, round(greatest(s, 0), 8) AS sumw, round(s2, 6) AS sumw2, s < 0 AS clipped FROM d"""
)
def signed_combination(spark, sf):
    """Signed sum of two sets with negative contents clipped and marked."""
    hist = channel_hist(spark, sf, "era")
    out = A.clip_negative(A.combine([(hist.filter("era < 1998"), 1.5), (hist.filter("era >= 1998"), -1.0)], ["ix"]))
    return out.select("ix", r("sumw", 8).alias("sumw"), r("sumw2").alias("sumw2"), "clipped")


@query(
    f"""WITH {SQL_EV}, base AS (SELECT channel AS process, era AS campaign, CASE WHEN status = 'F' THEN 'nominal' WHEN status = 'O' THEN 'sysA' ELSE 'sysB' END AS variation, {sql_bin('w', 10, 0.0, 5.0)} AS ix, sum(w) AS sumw
    FROM ev WHERE NOT (status = 'O' AND era < 1998) AND NOT (status = 'P' AND channel <> '2-HIGH') GROUP BY 1, 2, 3, 4),
want AS (SELECT DISTINCT process, variation AS target FROM base), camp AS (SELECT DISTINCT process, campaign FROM base), have AS (SELECT DISTINCT process, campaign, variation FROM base),
feed AS (SELECT c.process, c.campaign, w.target, CASE WHEN h.variation IS NULL THEN 'nominal' ELSE w.target END AS variation FROM camp c JOIN want w ON w.process = c.process LEFT JOIN have h ON h.process = c.process AND h.campaign = c.campaign AND h.variation = w.target)
SELECT process, target AS variation, ix, round(greatest(sum(sumw) * 2, 0), 9) AS sumw FROM feed JOIN base USING (process, campaign, variation) GROUP BY 1, 2, 3"""
)
def campaign_merge(spark, sf):
    """Campaigns merged; a variation falls back to the nominal where missing."""
    ev = heads(spark, sf, "channel", "era", "status", "w").filter("NOT (status = 'O' AND era < 1998) AND NOT (status = 'P' AND channel <> '2-HIGH')")
    ev = ev.withColumns(
        {
            "process": F.col("channel"),
            "campaign": F.col("era"),
            "variation": F.when(F.col("status") == "F", "nominal").when(F.col("status") == "O", "sysA").otherwise("sysB"),
        }
    )
    hist = H.fill(ev, [W], F.col("w"), ["process", "campaign", "variation"])
    out = A.merge_campaigns(hist, ["process"], scale_after=2.0)
    return out.select("process", "variation", "ix", r("sumw", 9).alias("sumw"))


@query(
    f"""{SQL_B.replace("SELECT pt, rel, score, w FROM obj", "SELECT pt, rel, score, w, channel, status FROM obj").replace("pt AS x, w FROM c", "pt AS x, w, channel, status FROM c").replace(", w FROM c", ", w, channel, status FROM c").replace("w * (1 + score / 5) FROM c", "w * (1 + score / 5), channel, status FROM c").replace("w * (1 - score / 10) FROM c", "w * (1 - score / 10), channel, status FROM c").split("h AS (")[0]}
g AS (SELECT status, channel, source, sum(w) AS t, sum(w) FILTER (direction = 'up') AS u, sum(w) FILTER (direction = 'down') AS d FROM v GROUP BY 1, 2, 3),
p AS (SELECT status, channel, sum(t) FILTER (source = 'nominal') AS rate, count(*) FILTER (source <> 'nominal' AND u > 0 AND d > 0) AS n_shapes FROM g GROUP BY 1, 2)
SELECT status AS category, channel AS process, round(rate, 8) AS rate, round(sum(rate) OVER (PARTITION BY status), 8) AS observation, n_shapes FROM p"""
)
def template_rates(spark, sf):
    """Rates, observation and usable shape variations per category and process."""
    ev = flat_events(spark, sf, ["rel", "pt", "score"], ["w", "channel", "status"])
    s = F.col("score")
    parts = F.array(
        F.struct(F.lit("nominal").alias("variation"), F.lit("").alias("direction"), F.col("w").alias("v")),
        F.struct(F.lit("rel").alias("variation"), F.lit("up").alias("direction"), F.col("w").alias("v")),
        F.struct(F.lit("rel").alias("variation"), F.lit("down").alias("direction"), F.col("w").alias("v")),
        F.struct(F.lit("wgt").alias("variation"), F.lit("up").alias("direction"), (F.col("w") * (1.0 + s / 5.0)).alias("v")),
        F.struct(F.lit("wgt").alias("variation"), F.lit("down").alias("direction"), (F.col("w") * (1.0 - s / 10.0)).alias("v")),
    )
    rows = ev.select(F.col("status").alias("category"), F.col("channel").alias("process"), F.inline(parts))
    hist = rows.groupBy("category", "process", "variation", "direction").agg(F.sum("v").alias("sumw"))
    out = A.template_table(hist, ["category"])
    return out.select("category", "process", r("rate", 8).alias("rate"), r("observation", 8).alias("observation"), "n_shapes")


@query(f"""{SQL_H} SELECT channel, round(sum(sumw) * CASE channel WHEN '1-URGENT' THEN 1.1 WHEN '2-HIGH' THEN 1.2 WHEN '3-MEDIUM' THEN 1.2 ELSE 1.05 END, 6) AS up FROM h GROUP BY channel""")
def rate_uncertainties(spark, sf):
    """Rate uncertainty per process: own entry, agreeing components, default."""
    direct = {"1-URGENT": [0.9, 1.1], "a": [0.8, 1.2], "b": [0.8, 1.2]}
    got = T.rate_uncertainty(direct, {"2-HIGH": ["a", "b"], "3-MEDIUM": ["a"]}, list(ROLES), default=[0.95, 1.05])
    hist = channel_hist(spark, sf, "channel")
    f = F.lit(1.0)
    for c, (_, up) in got.items():
        f = F.when(F.col("channel") == c, F.lit(up)).otherwise(f)
    return hist.groupBy("channel").agg(F.sum("sumw").alias("s")).select("channel", r(F.col("s") * f).alias("up"))


@query(f"""{SQL_H} SELECT channel, era, ix, round(sumw, 9) AS sumw, round(sumw2, 6) AS sumw2, n FROM h WHERE channel <> '5-LOW' UNION ALL SELECT 'new', era, ix, round(sumw * 2, 9), round(sumw2 * 4, 6), n FROM h WHERE channel = '1-URGENT'""")
def set_editing(spark, sf):
    """Histograms removed from and inserted into a set by key."""
    hist = channel_hist(spark, sf, "channel", "era")
    gone = hist.filter("channel = '5-LOW'").select("channel", "era").distinct()
    kept = A.remove(hist, gone)
    new = H.scale(hist.filter("channel = '1-URGENT'").withColumn("channel", F.lit("new")), F.lit(2.0))
    return _out(A.insert(kept, new, ["channel", "era", "ix"]), "channel", "era", "ix")


# --- transfer-factor fits ---------------------------------------------------------

FINE = Axis("pt", 24, 0.0, 120.0)
REGIONS = Axis("pt", edges=(0.0, 30.0, 60.0, 120.0))

SQL_FIT = f"""WITH {SQL_OBJ}, f AS (SELECT {sql_bin('pt', 24, 0.0, 120.0)} AS ix,
  sum(mass) FILTER (flag = 'R') AS sr, sum(mass * mass) FILTER (flag = 'R') AS sr2, sum(mass) FILTER (flag = 'A') AS "anti", sum(mass * mass) FILTER (flag = 'A') AS anti2,
  sum(mass) FILTER (flag = 'N') AS tight, sum(mass * mass) FILTER (flag = 'N') AS tight2 FROM obj GROUP BY 1),
b AS (SELECT CAST(x.ix AS INTEGER) AS ix, coalesce(sr, 0) AS sr, coalesce(sr2, 0) AS sr2, coalesce("anti", 0) AS "anti", coalesce(tight, 0) AS tight,
  CASE WHEN 5 * x.ix - 2.5 < 30 THEN 0 WHEN 5 * x.ix - 2.5 < 60 THEN 1 ELSE 2 END AS region FROM range(1, 25) x(ix) LEFT JOIN f ON f.ix = x.ix),
g AS (SELECT region, sum(sr) AS sr, sum(sr2) AS sr2, sum("anti") AS "anti", sum(tight) AS tight FROM b GROUP BY region),
q AS (SELECT *, "anti" / sum("anti") OVER () AS share FROM g)"""


def sql_solution(rows: str) -> str:
    """Weighted least squares of three regions by determinants, on regions or bins."""
    m = {(i, j): f"m{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}

    def minor(i: int, j: int) -> str:
        (a, b), (c, d) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"{sign}({m[a, c]} * {m[b, d]} - {m[a, d]} * {m[b, c]})"

    sums = ", ".join(f"sum(wt * r{i} * r{j}) AS m{i}{j}" for i in range(3) for j in range(i, 3))
    sums += ", " + ", ".join(f"sum(wt * r{i} * sr) AS b{i}" for i in range(3))
    cov = ", ".join(f"{minor(i, j)} / det AS c{i}{j}" for i in range(3) for j in range(3))
    pars = ", ".join(f"c{i}0 * b0 + c{i}1 * b1 + c{i}2 * b2 AS p{i}" for i in range(3))
    mean_var = " + ".join(f"s{i} * c{i}{j} * s{j}" for i in range(3) for j in range(3))
    rows_of = ", ".join(f"tight * s{i} + CASE WHEN region = {i} THEN \"anti\" ELSE 0 END AS r{i}" for i in range(3))
    return f""", sh AS (SELECT {", ".join(f"coalesce(max(share) FILTER (region = {i}), 0) AS s{i}" for i in range(3))} FROM q),
eq AS (SELECT *, {rows_of}, 1 / power(CASE WHEN sr2 > 0 THEN sqrt(sr2) WHEN sr > 0 THEN sqrt(sr) ELSE 1 END, 2) AS wt FROM {rows}, sh),
su AS (SELECT {sums}, count(*) AS n FROM eq), de AS (SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS det FROM su),
co AS (SELECT *, {cov} FROM de), pa AS (SELECT *, {pars} FROM co),
fit AS (SELECT pa.*, s0 * p0 + s1 * p1 + s2 * p2 AS mean, sqrt(greatest({mean_var}, 0)) AS mean_err FROM pa, sh)"""


def fit_bins(spark, sf):
    """One row per fine bin: signal region, anti and tight control sums."""
    flag = F.col("flag")
    rows = objects(spark, sf, "pt", "mass", "flag").select(FINE.index(F.col("pt")).alias("ix"), "mass", "flag")
    m = F.col("mass")
    aggs = []
    for name, f in (("sr", "R"), ("anti", "A"), ("tight", "N")):
        aggs += [F.coalesce(F.sum(F.when(flag == f, m)), F.lit(0.0)).alias(name), F.coalesce(F.sum(F.when(flag == f, m * m)), F.lit(0.0)).alias(f"{name}2")]
    # filled once, so the steps of a fit do not scan the events again
    stored = rows.groupBy("ix").agg(*aggs)
    every = spark.range(1, FINE.n + 1).select(F.col("id").cast("int").alias("ix"))
    return written(every.join(stored, "ix", "left").fillna(0.0))


@query(SQL_FIT + " SELECT CAST(region AS INTEGER) AS region, round(sr, 6) AS sr, round(\"anti\", 6) AS \"anti\", round(tight, 6) AS tight, round(share, 6) AS share FROM q")
def regions_of_bins(spark, sf):
    """Fine bins summed into regions by centre; share of each region."""
    out = T.region_shares(T.by_region(fit_bins(spark, sf), FINE, REGIONS))
    return out.select("region", *[r(c).alias(c) for c in ("sr", "anti", "tight", "share")])


@query(
    SQL_FIT
    + """, c AS (SELECT q.*, s0, s1, s2 FROM q, (SELECT max(share) FILTER (region = 0) AS s0, max(share) FILTER (region = 1) AS s1, max(share) FILTER (region = 2) AS s2 FROM q)),
e AS (SELECT region, tight * s0 + CASE WHEN region = 0 THEN "anti" ELSE 0 END AS r0, tight * s1 + CASE WHEN region = 1 THEN "anti" ELSE 0 END AS r1, tight * s2 + CASE WHEN region = 2 THEN "anti" ELSE 0 END AS r2, sr, 1 / sr2 AS wt FROM c)
SELECT round(sum(wt * r0 * r0), 4) AS m0_0, round(sum(wt * r0 * r1), 4) AS m0_1, round(sum(wt * r0 * r2), 4) AS m0_2, round(sum(wt * r1 * r1), 4) AS m1_1, round(sum(wt * r1 * r2), 4) AS m1_2, round(sum(wt * r2 * r2), 4) AS m2_2,
  round(sum(wt * r0 * sr), 4) AS b0, round(sum(wt * r1 * sr), 4) AS b1, round(sum(wt * r2 * sr), 4) AS b2 FROM e"""
)
def normal_equations(spark, sf):
    """Normal matrix and right-hand side of the region fit as distributed sums."""
    regions = T.region_shares(T.by_region(fit_bins(spark, sf), FINE, REGIONS))
    shares = T.share_list(regions, REGIONS.n)
    sums = T.normal_sums(T.region_rows(regions, shares), REGIONS.n)
    return sums.select(*[r(c, 4).alias(c) for c in sums.columns])


def _fit(spark, sf, level):
    """Bins, regions, shares, equations and solution of a fit on regions or bins."""
    bins = fit_bins(spark, sf)
    regions = written(T.region_shares(T.by_region(bins, FINE, REGIONS)))
    shares = T.share_list(regions, REGIONS.n)
    rows = regions if level == "region" else bins.withColumn("region", REGIONS.region(FINE.center(F.col("ix"))))
    rows = T.region_rows(rows, shares)
    return bins, regions, shares, rows, T.solve(rows, REGIONS.n)


@query(
    SQL_FIT
    + sql_solution("b")
    + """, pr AS (SELECT ix, sr, CASE WHEN sr2 > 0 THEN sqrt(sr2) WHEN sr > 0 THEN sqrt(sr) ELSE 1 END AS sigma,
  CASE region WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END * "anti" + mean * tight AS prediction FROM b, fit)
SELECT ix, round(sr, 6) AS sr, round(prediction, 4) AS prediction, round((sr - prediction) / sigma, 4) AS pull, CASE WHEN prediction = 0 THEN 0 ELSE round(sr / prediction, 4) END AS ratio FROM pr"""
)
def fitted_prediction(spark, sf):
    """Prediction, pull and ratio per fine bin from factors fitted on the bins."""
    bins, _, shares, _, sol = _fit(spark, sf, "bin")
    mean, _ = sol.mean(shares)
    out = T.predict(bins, REGIONS.region(FINE.center(F.col("ix"))), sol.params, mean)
    return out.select("ix", r("sr").alias("sr"), *[r(c, 4).alias(c) for c in ("prediction", "pull", "ratio")])


@query(
    SQL_FIT
    + sql_solution("q")
    + """ SELECT CAST(region AS INTEGER) AS region, round(sr, 3) AS sr, round(CASE region WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END * "anti" + mean * tight, 3) AS prediction FROM q, fit"""
)
def fit_closure(spark, sf):
    """With one factor per region the fit reproduces every region yield."""
    _, regions, shares, _, sol = _fit(spark, sf, "region")
    mean, _ = sol.mean(shares)
    out = T.predict(regions, F.col("region"), sol.params, mean)
    return out.select("region", r("sr", 3).alias("sr"), r("prediction", 3).alias("prediction"))


@query(
    SQL_FIT
    + sql_solution("b")
    + """, x AS (SELECT sum(wt * power(sr - r0 * p0 - r1 * p1 - r2 * p2, 2)) AS chi2, count(*) - 3 AS ndof FROM eq, fit)
SELECT round(chi2, 4) AS chi2, ndof, round(chi2 / ndof, 4) AS chi2_ndof, round(mean, 6) AS mean, round(mean_err, 6) AS mean_error FROM x, fit"""
)
def fit_quality(spark, sf):
    """chi2, degrees of freedom and mean factor of the fit on fine bins."""
    _, _, shares, rows, sol = _fit(spark, sf, "bin")
    mean, err = sol.mean(shares)
    out = T.goodness(rows, sol.params)
    return out.select(r("chi2", 4).alias("chi2"), "ndof", r("chi2_ndof", 4).alias("chi2_ndof"), F.lit(round(mean, 6)).alias("mean"), F.lit(round(err, 6)).alias("mean_error"))


@query(
    f"""WITH {SQL_OBJ}, f AS (SELECT {sql_bin('pt', 24, 0.0, 120.0)} AS ix, {sql_bin('eta', 8, -2.4, 2.4)} AS iy, flag, mass FROM obj),
b AS (SELECT CASE WHEN 5 * ix - 2.5 < 30 THEN 0 WHEN 5 * ix - 2.5 < 60 THEN 1 ELSE 2 END + 3 * CASE WHEN iy <= 4 THEN 0 ELSE 1 END AS region, flag, mass FROM f WHERE ix BETWEEN 1 AND 24 AND iy BETWEEN 1 AND 8)
SELECT CAST(region AS INTEGER) AS region, round(sum(mass) FILTER (flag = 'R'), 6) AS sr, round(sum(mass) FILTER (flag = 'A'), 6) AS "anti", round(sum(mass) FILTER (flag = 'N'), 6) AS tight FROM b GROUP BY 1"""
)
def regions_2d(spark, sf):
    """Two-dimensional cells: index = iy * nx + ix."""
    eta, halves = Axis("eta", 8, -2.4, 2.4), Axis("eta", edges=(-2.4, 0.0, 2.4))
    o = objects(spark, sf, "pt", "eta", "mass", "flag")
    flag, m = F.col("flag"), F.col("mass")
    aggs = []
    for name, f in (("sr", "R"), ("anti", "A"), ("tight", "N")):
        aggs += [F.sum(F.when(flag == f, m)).alias(name), F.sum(F.when(flag == f, m * m)).alias(f"{name}2")]
    bins = o.select(FINE.index(F.col("pt")).alias("ix"), eta.index(F.col("eta")).alias("iy"), "mass", "flag").groupBy("ix", "iy").agg(*aggs)
    bins = bins.filter(F.col("ix").between(1, FINE.n) & F.col("iy").between(1, eta.n))
    out = T.by_region(bins, FINE, REGIONS, eta, halves)
    return out.select("region", *[r(c).alias(c) for c in ("sr", "anti", "tight")])


@query(
    f"""{SQL_H} SELECT ix, round(sum(CASE WHEN channel IN ('1-URGENT', '2-HIGH') THEN sumw WHEN channel = '3-MEDIUM' THEN -0.5 * sumw ELSE -sumw END), 8) AS sumw,
  round(sum(CASE WHEN channel = '3-MEDIUM' THEN 0.25 * sumw2 ELSE sumw2 END), 6) AS sumw2 FROM h WHERE channel <> '5-LOW' GROUP BY ix"""
)
def residual_histogram(spark, sf):
    """Data minus selected processes with their scales."""
    c = F.col("channel")
    out = T.residual(channel_hist(spark, sf, "channel", "era"), ["ix"], c.isin("1-URGENT", "2-HIGH"), c.isin("3-MEDIUM", "4-NOT SPECIFIED"), "channel", {"3-MEDIUM": 0.5})
    return out.select("ix", r("sumw", 8).alias("sumw"), r("sumw2").alias("sumw2"))


@query(f"""{SQL_H} SELECT channel, era, round(sum(sumw - 1), 8) AS integral, count(*) AS bins, count(*) FILTER (sumw - 1 < 0) AS negative_bins FROM h GROUP BY 1, 2""")
def component_summaries(spark, sf):
    """Integral, bins and negative bins of every component."""
    hist = channel_hist(spark, sf, "channel", "era").withColumn("sumw", F.col("sumw") - 1.0)
    return T.components(hist, ["channel", "era"]).withColumn("integral", r("integral", 8))


@query(
    f"""WITH {SQL_EV}, h AS (SELECT channel, CASE WHEN status = 'F' THEN 'nominal' ELSE status END AS variation, {sql_bin('w', 10, 0.0, 5.0)} AS ix, sum(w) AS s FROM ev WHERE channel IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') GROUP BY 1, 2, 3),
f AS (SELECT v.variation, ix, s FROM h, (VALUES ('nominal'), ('O'), ('P')) v(variation) WHERE channel = '4-NOT SPECIFIED' AND h.variation = 'nominal' UNION ALL SELECT variation, ix, s FROM h WHERE channel <> '4-NOT SPECIFIED')
SELECT variation, ix, round(sum(s), 9) AS sumw FROM f GROUP BY 1, 2"""
)
def stack_totals(spark, sf):
    """Stack total under each variation, the data-driven part kept nominal."""
    ev = heads(spark, sf, "channel", "status", "w").withColumn("variation", F.when(F.col("status") == "F", "nominal").otherwise(F.col("status")))
    hist = H.fill(ev, [W], F.col("w"), ["channel", "variation"])
    roles = A.channel_roles(list(ROLES), data=["5-LOW"], data_driven={"4-NOT SPECIFIED": 1}, signal=["1-URGENT"])
    assert roles["1-URGENT"] == {"signal", "overlay"}
    out = A.stack_total(hist, ["ix"], roles)
    return out.select("variation", "ix", r("sumw", 9).alias("sumw"))
