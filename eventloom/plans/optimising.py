"""Cut scans, score mixing and binning optimisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import optimise as O
from eventloom.operators.scale import values_table
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, heads, objects, r


def scored(spark, sf):
    """Objects with three scores and signal and background weights."""
    o = objects(spark, sf, "score", "rel", "mass", "flag", "pt")
    is_sig = F.col("flag") == "R"
    return o.select(
        "pt",
        ((F.col("score") + 0.1) / 1.2).alias("s0"),
        (F.col("rel") * 8.0 + 0.1).alias("s1"),
        F.least(F.col("mass") / 5.0, F.lit(1.0)).alias("s2"),
        F.when(is_sig, F.col("mass") / 50.0).otherwise(F.lit(0.0)).alias("sig"),
        F.when(is_sig, 0.0).otherwise(F.col("mass")).alias("bkg"),
    )


SQL_SC = f"""WITH {SQL_OBJ}, sc AS (SELECT pt, (score + 0.1::DOUBLE) / 1.2::DOUBLE AS s0, rel * 8 + 0.1::DOUBLE AS s1, least(mass / 5, 1.0::DOUBLE) AS s2,
  CASE WHEN flag = 'R' THEN mass / 50 ELSE 0.0::DOUBLE END AS sig, CASE WHEN flag = 'R' THEN 0.0::DOUBLE ELSE mass END AS bkg FROM obj)"""

ASIMOV = "CASE WHEN s > 0 AND b > 0 THEN sqrt(greatest(0, 2 * ((s + b) * ln(1 + s / b) - s))) ELSE 0 END"


def sql_scan(rows: str, score: str, scans: int, group: str = "") -> str:
    """Scan over distinct scores with the candidate rule on ranks."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    return f"""v AS (SELECT {g}{score} AS x, sum(sig) AS s, sum(bkg) AS b, sum(c) AS n FROM {rows} GROUP BY {g}{score}),
u AS (SELECT {g}x, n, sum(s) OVER w AS s, sum(b) OVER w AS b, sum(n) OVER w AS rk, sum(n) OVER ({part}) AS total FROM v WINDOW w AS ({part} ORDER BY x DESC)),
k AS (SELECT *, least(CAST({scans} AS BIGINT), total) AS cc FROM u),
j AS (SELECT *, CASE WHEN rk <= 0 THEN 0 ELSE least(cc, greatest(CAST(ceil(rk * (cc - 1) / greatest(total - 1, 1)) AS BIGINT), 1)) END AS here,
  CASE WHEN rk - n <= 0 THEN 0 ELSE least(cc, greatest(CAST(ceil((rk - n) * (cc - 1) / greatest(total - 1, 1)) AS BIGINT), 1)) END AS above FROM k),
curve AS (SELECT *, {ASIMOV} AS z FROM j WHERE here > above)"""


@query(
    f"""{SQL_SC}, rows_ AS (SELECT *, 1 AS c FROM sc), {sql_scan('rows_', 'pt', 50)}
SELECT round(x, 9) AS threshold, CAST(rk AS BIGINT) AS rank, round(s, 6) AS signal_yield, round(b, 5) AS background_yield, round(z, 6) AS significance FROM curve"""
)
def cut_scan(spark, sf):
    """Yields and significance at evenly spread cuts of one score."""
    curve = O.cut_scan(scored(spark, sf), "pt", "sig", "bkg", 50)
    return curve.select(
        r("threshold", 9).alias("threshold"),
        "rank",
        r("signal_yield").alias("signal_yield"),
        r("background_yield", 5).alias("background_yield"),
        r("significance").alias("significance"),
    )


@query(
    f"""{SQL_SC}, rows_ AS (SELECT *, 1 AS c FROM sc), {sql_scan('rows_', 's0', 400)}
SELECT round(x, 9) AS threshold, CAST(rk AS BIGINT) AS rank, round(z, 6) AS significance, round(CASE WHEN s > 0 AND b > 0 THEN s / sqrt(b) ELSE 0 END, 6) AS simple FROM curve WHERE s > 0 AND b > 0 ORDER BY z DESC, x DESC LIMIT 1"""
)
def best_cut(spark, sf):
    """Best cut of a score with many equal values."""
    best = O.best_cut(O.cut_scan(scored(spark, sf), "s0", "sig", "bkg", 400))
    z = O.simple_significance(F.col("signal_yield"), F.col("background_yield"))
    return best.select(r("threshold", 9).alias("threshold"), "rank", r("significance").alias("significance"), r(z).alias("simple"))


GRID = O.simplex_grid(0.25, 3)


def _sql_grid(points):
    return "grid(point, w0, w1, w2) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(points)) + ")"


@query(
    f"""{SQL_SC}, {_sql_grid([g for g in GRID if g[0] >= 0.25])},
rows_ AS (SELECT point, w0 * s0 / (0.0::DOUBLE + w0 * s0 + w1 * s1 + w2 * s2 + 0.000001::DOUBLE) AS mix, sum(sig) AS sig, sum(bkg) AS bkg, count(*) AS c FROM (SELECT s0, s1, s2, sum(sig) AS sig, sum(bkg) AS bkg, count(*) AS c FROM sc GROUP BY 1, 2, 3) t, grid, range(c) GROUP BY point, mix),
{sql_scan('rows_', 'mix', 100, 'point')},
best AS (SELECT point, max(z) AS z FROM curve WHERE s > 0 AND b > 0 GROUP BY point)
SELECT CAST(point AS INTEGER) AS point, w0, round(z, 4) AS significance FROM best JOIN grid USING (point)"""
    .replace("sum(sig) AS sig, sum(bkg) AS bkg, count(*) AS c FROM (SELECT s0, s1, s2, sum(sig) AS sig, sum(bkg) AS bkg, count(*) AS c FROM sc GROUP BY 1, 2, 3) t, grid, range(c) GROUP BY point, mix", "sum(sig) AS sig, sum(bkg) AS bkg, count(*) AS c FROM sc, grid GROUP BY point, mix")
)
def mix_ranking(spark, sf):
    """Best cut of every weight vector of the bound score mix."""
    out = O.rank_mixes(scored(spark, sf), ["s0", "s1", "s2"], "sig", "bkg", GRID, 100, bound=True, min_signal=0.25)
    return out.select("point", F.get("weights", F.lit(0)).alias("w0"), r("significance", 4).alias("significance"))


def _sql_unbound():
    points = [(0.5, 0.5), *O.simplex_grid(0.25, 2)]
    return "grid(point, w1, w2) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(points)) + ")"


@query(
    f"""{SQL_SC}, {_sql_unbound()}, rows_ AS (
  SELECT point, s0 / (0.0::DOUBLE + w1 * s1 + w2 * s2 + 0.000001::DOUBLE) AS x0, sig, bkg, 1 AS c FROM sc, grid UNION ALL SELECT -1, s0, sig, bkg, 1 FROM sc),
{sql_scan('rows_', 'x0', 100, 'point')}, best AS (SELECT point, max(z) AS z FROM curve WHERE s > 0 AND b > 0 GROUP BY point)
SELECT CASE point WHEN -1 THEN 'baseline' WHEN 0 THEN 'uniform' ELSE 'best' END AS kind, round(max(z), 4) AS significance FROM best GROUP BY 1"""
)
def mix_comparison(spark, sf):
    """Pure signal score, uniform mix and best unbound mix against each other."""
    df = scored(spark, sf)
    base = O.best_cut(O.cut_scan(df, "s0", "sig", "bkg", 100)).select(F.lit("baseline").alias("kind"), r("significance", 4).alias("significance"))
    uniform = O.rank_mixes(df, ["s0", "s1", "s2"], "sig", "bkg", [(0.5, 0.5)], 100, bound=False)
    ranking = O.rank_mixes(df, ["s0", "s1", "s2"], "sig", "bkg", O.simplex_grid(0.25, 2), 100, bound=False)
    best = ranking.orderBy(F.desc("significance"), "point").limit(1)
    pick = lambda d, n: d.select(F.lit(n).alias("kind"), r("significance", 4).alias("significance"))
    return base.unionByName(pick(uniform, "uniform")).unionByName(pick(best, "best"))


@query(
    f"""WITH {SQL_OBJ}, v AS (SELECT least(greatest(pt, 5.0), 80.0) AS x, sum(abs(mass)) AS w FROM obj GROUP BY 1),
c AS (SELECT x, sum(w) OVER (ORDER BY x) AS cum, row_number() OVER (ORDER BY x) AS no, sum(w) OVER () AS total, count(*) OVER () AS m FROM v),
t AS (SELECT range AS kk FROM range(1, 8)),
a AS (SELECT kk, least(greatest(count(*) FILTER (cum < total * kk / 8), 1), any_value(m) - 1) AS posn FROM c, t GROUP BY kk)
SELECT CAST(kk AS INTEGER) AS edge_no, round(0.5 * (p.x + q.x), 9) AS edge FROM a JOIN c p ON p.no = posn JOIN c q ON q.no = posn + 1 UNION ALL SELECT 0, 5.0 UNION ALL SELECT 8, 80.0"""
)
def equal_content_edges(spark, sf):
    """Edges of bins with equal content."""
    edges = O.equal_content_edges(objects(spark, sf, "pt", "mass"), "pt", "mass", 8, "abs", 5.0, 80.0)
    return values_table(spark, "edge_no int, edge double", [(i, round(e, 9)) for i, e in enumerate(edges)])


@query(
    f"""WITH {SQL_OBJ}, b AS (SELECT CASE WHEN pt >= 0 AND pt < 20 THEN 1 WHEN pt >= 20 AND pt < 50 THEN 2 WHEN pt >= 50 AND pt <= 90 THEN 3 END AS bin, mass * charge AS w FROM obj)
SELECT CAST(bin AS INTEGER) AS bin, CASE bin WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 20 ELSE 50 END AS low, CASE bin WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 50 ELSE 90 END AS high, count(*) AS entries,
  round(sum(w), 6) AS signed_weight_sum, round(sum(abs(w)), 6) AS abs_weight_sum, round(sum(greatest(w, 0)), 6) AS optimisation_weight_sum FROM b WHERE bin IS NOT NULL GROUP BY bin"""
)
def bin_summary(spark, sf):
    """Entries and weight sums per bin."""
    df = objects(spark, sf, "pt", "mass", "charge").withColumn("sw", F.col("mass") * F.col("charge"))
    out = O.bin_summary(df, "pt", "sw", [0.0, 20.0, 50.0, 90.0], "positive")
    return out.select("bin", "low", "high", "entries", *[r(c).alias(c) for c in ("signed_weight_sum", "abs_weight_sum", "optimisation_weight_sum")])


@query(
    f"""WITH {SQL_EV} SELECT row_number() OVER (ORDER BY w DESC, k) AS place, k, round(w, 9) AS w FROM ev QUALIFY place <= 25"""
)
def top_ranked(spark, sf):
    """Ranked list of the best rows with a stable tie-break (a top-k report)."""
    ev = heads(spark, sf, "w").orderBy(F.desc("w"), "k").limit(25)
    from pyspark.sql import Window

    # the window sees the 25 report rows only
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), "k")).cast("long")
    return ev.select(place.alias("place"), "k", r("w", 9).alias("w"))


@query(
    f"""WITH {SQL_EV}, t AS (SELECT channel, sum(w) AS total FROM ev GROUP BY 1)
SELECT channel, starts_with(channel, '1') AS is_signal, count(*) AS n, round(sum(w * (17.5 * 2 * 1000 / total) * CASE WHEN starts_with(channel, '2') THEN 1.5 ELSE 1 END), 4) AS scaled FROM ev JOIN t USING (channel) WHERE w > 0.3 GROUP BY channel"""
)
def labelled_samples(spark, sf):
    """Signal and background channels by name pattern, normalised per channel,
    one family with an extra scale."""
    from eventloom.operators.scale import attach_totals
    from eventloom.operators.weights import mc_scale

    ev = attach_totals(heads(spark, sf, "channel", "w"), ["channel"], total=F.sum("w")).filter("w > 0.3")
    extra = F.when(F.col("channel").startswith("2"), 1.5).otherwise(F.lit(1.0))
    w = F.col("w") * mc_scale(F.lit(17.5), F.lit(2.0), F.col("total")) * extra
    return ev.groupBy("channel", F.col("channel").startswith("1").alias("is_signal")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(w), 4).alias("scaled"))
