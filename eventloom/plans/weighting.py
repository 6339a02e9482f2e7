"""Balancing, efficiencies, reports, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators import quality as Q
from eventloom.operators import splits as S
from eventloom.operators import weights as W
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, flat_events, heads, events, objects, r, sql_bin, sql_edges, table


def signed(spark, sf, *more):
    """Events with a weight of either sign."""
    return heads(spark, sf, "status", "channel", "era", "w", *more).withColumn("sw", F.col("w") - 1.0)


SQL_S = f"WITH {SQL_EV}, s AS (SELECT *, w - 1.0::DOUBLE AS sw FROM ev)"


@query(
    f"""{SQL_S}, g AS (SELECT status, channel, sum(abs(sw)) AS t FROM s GROUP BY 1, 2), c AS (SELECT status, count(*) FILTER (t > 0) AS m FROM g GROUP BY 1)
SELECT k, round(abs(sw) / m / t * 1000, 6) AS balanced FROM s JOIN g USING (status, channel) JOIN c USING (status)"""
)
def balanced_weights(spark, sf):
    """Every (class, group) sums to 1 / number of groups of the class."""
    out = W.balanced(signed(spark, sf), "sw", "status", "channel")
    return out.select("k", r(F.col("balanced") * 1000).alias("balanced"))


@query(f"""{SQL_S}, g AS (SELECT status, sum(abs(sw)) AS t FROM s GROUP BY 1) SELECT k, round(abs(sw) / t * 1000, 6) AS normalised FROM s JOIN g USING (status)""")
def class_normalised_weights(spark, sf):
    """|w| over its class sum."""
    out = W.class_normalised(signed(spark, sf), "sw", "status")
    return out.select("k", r(F.col("normalised") * 1000).alias("normalised"))


@query(
    f"""WITH {SQL_EV}, g AS (SELECT status, sum(w) AS t FROM ev GROUP BY 1), a AS (SELECT sum(t) AS total, sum(CASE status WHEN 'F' THEN 2.0 WHEN 'O' THEN 0.5 ELSE 1.0 END) AS parts FROM g)
SELECT k, round(w * total * CASE status WHEN 'F' THEN 2.0 WHEN 'O' THEN 0.5 ELSE 1.0 END / parts / t, 6) AS targeted FROM ev JOIN g USING (status), a"""
)
def class_target_weights(spark, sf):
    """Relative class targets that keep the total."""
    out = W.class_targets(heads(spark, sf, "status", "w"), "w", "status", {"F": 2.0, "O": 0.5})
    return out.select("k", r("targeted").alias("targeted"))


@query(
    f"""WITH {SQL_EV}, g AS (SELECT status, channel, sum(w) AS t FROM ev GROUP BY 1, 2),
c AS (SELECT status, sum(t) AS total, sum(t) FILTER (NOT (status = 'F' AND channel IN ('1-URGENT', '2-HIGH'))) AS rest FROM g GROUP BY 1)
SELECT k, round(w * CASE WHEN status <> 'F' THEN 1 WHEN channel = '1-URGENT' THEN total * 0.5 / t WHEN channel = '2-HIGH' THEN total * 0.2 / t ELSE total * 0.3 / rest END, 9) AS shared
FROM ev JOIN g USING (status, channel) JOIN c USING (status)"""
)
def channel_share_weights(spark, sf):
    """Fixed channel shares in a class, the remainder spread in proportion."""
    out = W.channel_shares(heads(spark, sf, "status", "channel", "w"), "w", "status", "channel", {"F": {"1-URGENT": 0.5, "2-HIGH": 0.2}})
    return out.select("k", r("shared", 9).alias("shared"))


@query(
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label < 8 GROUP BY label), x AS (SELECT CAST(range AS INTEGER) AS label FROM range(8) UNION ALL SELECT 77)
SELECT x.label, coalesce(n, 0) AS n, round(CASE WHEN n IS NULL THEN 0 ELSE (SELECT sum(n) FROM c) / (n * 9.0::DOUBLE) END, 6) AS class_weight FROM x LEFT JOIN c USING (label)"""
)
def inverse_frequency_weights(spark, sf):
    """Class weight N / (n_c k), 0 for an empty class."""
    out = W.inverse_frequency(table(spark, sf, "embeddings"), "label", [*range(8), 77])
    return out.withColumn("class_weight", r("class_weight"))


@query(
    f"""{SQL_S}, g AS (SELECT status, sum(abs(sw)) AS t FROM s GROUP BY 1)
SELECT channel, count(*) AS n_events, round(sum(sw), 8) AS before_sum, round(sum(abs(sw) / t), 6) AS after_sum, round(sum(abs(sw) / t) / sum(sw), 6) AS effective_scale FROM s JOIN g USING (status) GROUP BY channel"""
)
def reweighting_effect(spark, sf):
    """Sums per channel before and after a reweighting."""
    out = W.reweighting_report(W.class_normalised(signed(spark, sf), "sw", "status"), ["channel"], "sw", "normalised")
    return out.select("channel", "n_events", r("before_sum", 8).alias("before_sum"), r("after_sum").alias("after_sum"), r("effective_scale").alias("effective_scale"))


EFF_EDGES = (5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 75.0, 90.0, 105.0)


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, b AS (SELECT flag, {sql_edges('pt', EFF_EDGES)} AS ix, score, w FROM obj JOIN ev USING (k) WHERE abs(eta) < 2.2 AND w > 0.2),
c AS (SELECT flag, ix, sum(w) AS den, coalesce(sum(w) FILTER (score > 0.2), 0) AS nl, coalesce(sum(w) FILTER (score > 0.5), 0) AS nm, coalesce(sum(w) FILTER (score > 0.8), 0) AS nt FROM b WHERE ix BETWEEN 1 AND 8 GROUP BY 1, 2)
SELECT flag, ix, 'L' AS working_point, round(den, 9) AS den, round(nl, 9) AS num, round(least(greatest(nl / den, 0), 1), 6) AS eff FROM c
UNION ALL SELECT flag, ix, 'M', round(den, 9), round(nm, 9), round(least(greatest(nm / den, 0), 1), 6) FROM c UNION ALL SELECT flag, ix, 'T', round(den, 9), round(nt, 9), round(least(greatest(nt / den, 0), 1), 6) FROM c"""
)
def tag_efficiencies(spark, sf):
    """Weighted efficiency per flavour, pt bin and working point."""
    axis = Axis("pt", edges=EFF_EDGES)
    rows = flat_events(spark, sf, ["pt", "eta", "flag", "score"], ["w"]).filter("abs(eta) < 2.2 AND w > 0.2")
    rows = rows.select("flag", axis.index(F.col("pt")).alias("ix"), "score", "w").filter(F.col("ix").between(1, axis.n))
    cuts = {"L": 0.2, "M": 0.5, "T": 0.8}
    out = W.tag_efficiency(rows, ["flag", "ix"], "w", {wp: F.col("score") > c for wp, c in cuts.items()})
    return out.select("flag", "ix", "working_point", r("den", 9).alias("den"), r("num", 9).alias("num"), r("eff").alias("eff"))


@query(
    f"""WITH {SQL_EV}, b AS (SELECT {sql_bin('w', 10, 0.0, 5.0)} AS ix, w, w > 0.5 AS thr, status = 'F' AS fired FROM ev),
h AS (SELECT least(ix, 10) AS ix, sum(w) FILTER (thr) AS den, sum(w * w) FILTER (thr) AS den2, coalesce(sum(w) FILTER (thr AND fired), 0) AS num, coalesce(sum(w * w) FILTER (thr AND fired), 0) AS num2 FROM b GROUP BY 1)
SELECT CAST(ix AS INTEGER) AS ix, round(coalesce(num / den, 0), 6) AS eff, round(coalesce(sqrt(abs(((1 - 2 * num / den) * num2 + num / den * (num / den) * den2) / (den * den))), 0), 6) AS error FROM h"""
)
def trigger_efficiency(spark, sf):
    """Fired-and-threshold over threshold with weighted binomial errors, overflow merged."""
    ax = Axis("w", 10, 0.0, 5.0)
    thr, w = F.col("w") > 0.5, F.col("w")
    both = thr & (F.col("status") == "F")
    rows = heads(spark, sf, "status", "w").withColumn("ix", F.least(ax.index(w), F.lit(ax.n)))
    z = F.lit(0.0)
    sums = rows.groupBy("ix").agg(
        *[F.coalesce(F.sum(F.when(c, v)), z).alias(n) for n, c, v in (("den", thr, w), ("den2", thr, w * w), ("num", both, w), ("num2", both, w * w))]
    )
    return W.binomial_efficiency(sums).select("ix", r("eff").alias("eff"), r("error").alias("error"))


@query(
    f"""WITH {SQL_OBJ}, e AS (SELECT k, max(CASE WHEN flag = 'A' AND pt > 20 THEN 1.0 ELSE 0.0 END) AS a, max(CASE WHEN flag = 'N' AND pt > 30 THEN 1.0 ELSE 0.0 END) AS b FROM obj GROUP BY k)
SELECT k, round(1 - (1 - a / 4) * (1 - b / 1.5), 9) AS weight FROM e"""
)
def prescaled_or_weight(spark, sf):
    """Weighted OR of prescaled paths."""
    ev = events(spark, sf, ["pt", "flag"]).filter(F.size("obj") > 0)
    fired = lambda f, t: F.exists("obj", lambda o: (o["flag"] == f) & (o["pt"] > t))
    return ev.select("k", r(W.prescaled_or([fired("A", 20), fired("N", 30)], [4.0, 1.5]), 9).alias("weight"))


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, n AS (SELECT k, count(*) FILTER (flag = 'N') AS c FROM obj GROUP BY k)
SELECT CAST(least(coalesce(c, 0), 3) AS INTEGER) AS n_true, round(sum(w) * 108.96, 6) AS yield FROM ev LEFT JOIN n USING (k) GROUP BY 1"""
)
def truth_category_yields(spark, sf):
    """Weighted yields by number of true objects (0, 1, 2, 3 and more)."""
    ev = events(spark, sf, ["flag"], ["w"])
    n = F.least(F.size(F.filter("obj", lambda o: o["flag"] == "N")), F.lit(3)).alias("n_true")
    return ev.select(n, "w").groupBy("n_true").agg(r(F.sum("w") * 108.96).alias("yield"))


@query(
    f"""WITH {SQL_OBJ}, {SQL_EV}, n AS (SELECT k, count(*) FILTER (flag = 'N') AS c, bool_or(i = 0 AND flag = 'N') AS a, bool_or(i = 1 AND flag = 'N') AS b FROM obj GROUP BY k),
x AS (SELECT w, coalesce(c, 0) AS c, CAST(coalesce(a, FALSE) AS INTEGER) + CAST(coalesce(b, FALSE) AS INTEGER) AS reco FROM ev LEFT JOIN n USING (k))
SELECT 'true' AS kind, CAST(least(c, 3) AS INTEGER) AS category, count(*) AS n, round(sum(w) * 108.96, 6) AS yield FROM x GROUP BY 2
UNION ALL SELECT 'reco', reco, count(*), round(sum(w) * 108.96, 6) FROM x GROUP BY 2"""
)
def prompt_report(spark, sf):
    """Yields by true prompt objects and by prompt ones among the two leading."""
    ev = events(spark, sf, ["flag"], ["w"])
    prompt = lambda o: o["flag"] == "N"
    flag = lambda i: prompt(F.get("obj", F.lit(i)))
    out = Q.prompt_counts(ev, F.size(F.filter("obj", prompt)), flag(0), flag(1), F.col("w"), 108.96)
    return out.select("kind", "category", "n", r("yield").alias("yield"))


@query(
    f"""{SQL_S}, x AS (SELECT *, sw > 0 AS pos FROM s)
SELECT 'all' AS part, CAST(NULL AS VARCHAR) AS value, count(*) AS n_events, round(sum(sw), 8) AS weight_sum, round(sum(abs(sw)), 8) AS abs_weight_sum FROM x
UNION ALL SELECT 'sign', CAST(pos AS VARCHAR), count(*), round(sum(sw), 8), round(sum(abs(sw)), 8) FROM x GROUP BY pos
UNION ALL SELECT 'label', status, count(*), round(sum(sw), 8), round(sum(abs(sw)), 8) FROM x GROUP BY status
UNION ALL SELECT 'channel', channel, count(*), round(sum(sw), 8), round(sum(abs(sw)), 8) FROM x GROUP BY channel"""
)
def dataset_report(spark, sf):
    """Counts and weight sums in total, per sign, label and channel."""
    df = signed(spark, sf).withColumn("pos", F.col("sw") > 0)
    out = Q.dataset_report(df, "sw", "pos", "status", "channel")
    return out.select("part", "value", "n_events", r("weight_sum", 8).alias("weight_sum"), r("abs_weight_sum", 8).alias("abs_weight_sum"))


def predicted(spark, sf):
    """Vectors with truth, an index of the largest of ten components, a weight."""
    e = table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").cast("int").alias("truth"),
        F.slice("embedding", 1, 10).alias("s"),
        (F.get("embedding", F.lit(10)).cast("double") * 4.0).alias("weight"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(4)],
    )
    return e.withColumn("pred", (F.array_position("s", F.array_max("s")) - 1).cast("int"))


SQL_P = """WITH p AS (SELECT vec_id, CAST(label AS INTEGER) AS truth, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS pred,
  CAST(embedding[11] AS DOUBLE) * 4 AS weight, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, CAST(embedding[3] AS DOUBLE) AS f2, CAST(embedding[4] AS DOUBLE) AS f3 FROM embeddings)"""


@query(
    SQL_P
    + """ SELECT truth, round(sum(CASE WHEN truth = pred THEN abs(weight) ELSE 0 END) / sum(abs(weight)), 6) AS accuracy, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS unweighted FROM p GROUP BY truth"""
)
def accuracies(spark, sf):
    """Weighted and plain accuracy per class."""
    out = Q.accuracy(predicted(spark, sf), "truth", "pred", "weight", ["truth"])
    return out.select("truth", r("accuracy").alias("accuracy"), r("unweighted").alias("unweighted"))


@query(SQL_P + """, c AS (SELECT truth, pred, count(*) AS n FROM p WHERE truth < 8 AND pred < 8 GROUP BY 1, 2) SELECT truth, pred, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS fraction FROM c""")
def confusion_matrix(spark, sf):
    """Confusion per true class, labels outside the range ignored."""
    return Q.confusion(predicted(spark, sf), "truth", "pred", 8).withColumn("fraction", r("fraction"))


@query(
    SQL_P
    + """, u AS (SELECT abs(weight) AS w, [f0, f1, f2] AS f FROM p), x AS (SELECT a.range AS i, b.range AS j FROM range(3) a, range(3) b WHERE a.range <= b.range),
m AS (SELECT i, j, sum(w * f[i + 1]) / sum(w) AS mi, sum(w * f[j + 1]) / sum(w) AS mj, sum(w * f[i + 1] * f[j + 1]) / sum(w) AS mij, sum(w * f[i + 1] * f[i + 1]) / sum(w) AS mii, sum(w * f[j + 1] * f[j + 1]) / sum(w) AS mjj FROM u, x GROUP BY i, j)
SELECT 'f' || CAST(i AS VARCHAR) AS a, 'f' || CAST(j AS VARCHAR) AS b, round(mi, 6) AS mean_a, round(mj, 6) AS mean_b, round(mij - mi * mj, 6) AS covariance,
  round(CASE WHEN mii - mi * mi > 0 AND mjj - mj * mj > 0 THEN least(greatest((mij - mi * mj) / sqrt((mii - mi * mi) * (mjj - mj * mj)), -1), 1) ELSE 0 END, 6) AS correlation FROM m"""
)
def covariance_matrix(spark, sf):
    """Weighted means, covariances and correlations of features."""
    df = predicted(spark, sf).withColumn("weight", F.abs("weight"))
    out = Q.covariance(df, ["f0", "f1", "f2"], "weight")
    return out.select("a", "b", *[r(c).alias(c) for c in ("mean_a", "mean_b", "covariance", "correlation")])


@query(
    SQL_P
    + """, g AS (SELECT truth, sum(weight) AS w, sum(f0 * weight) AS s0, avg(f0) AS a0, sum(f1 * weight) AS s1, avg(f1) AS a1 FROM p GROUP BY truth)
SELECT truth, 'f0' AS score, round(CASE WHEN w > 0 THEN s0 / w ELSE a0 END, 6) AS mean FROM g UNION ALL SELECT truth, 'f1', round(CASE WHEN w > 0 THEN s1 / w ELSE a1 END, 6) FROM g"""
)
def score_means(spark, sf):
    """Mean score per class and field, plain where the weights do not help."""
    return Q.score_means(predicted(spark, sf), ["truth"], ["f0", "f1"], "weight").withColumn("mean", r("mean"))


@query(SQL_P + " SELECT vec_id, CAST(CASE truth WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS truth FROM p WHERE truth IN (7, 2, 5)")
def label_subset(spark, sf):
    """Chosen labels, numbered again."""
    return Q.relabel(predicted(spark, sf).select("vec_id", "truth"), "truth", [7, 2, 5])


@query(f"""{SQL_S} SELECT 'positive' AS rule, count(*) FILTER (NOT sw > 0) AS violations FROM s UNION ALL SELECT 'known era', count(*) FILTER (NOT era BETWEEN 1995 AND 2000) FROM s""")
def contract_checks(spark, sf):
    """Violations of the dataset contract per rule."""
    return Q.check_contract(signed(spark, sf), ["status", "sw"], {"positive": F.col("sw") > 0, "known era": F.col("era").between(1995, 2000)})


@query(
    f"""WITH {SQL_OBJ}, b AS (SELECT 'pt' AS feature, flag, CAST(least(greatest({sql_bin('pt', 10, 10.0, 60.0)}, 1), 10) AS INTEGER) AS ix, mass FROM obj
  UNION ALL SELECT 'jet_btag', flag, CAST(least(greatest({sql_bin('score', 40, 0.0, 1.0)}, 1), 40) AS INTEGER), mass FROM obj
  UNION ALL SELECT 'dr_pair', flag, CAST(least(greatest({sql_bin('phi + 3.14', 40, 0.0, 5.0)}, 1), 40) AS INTEGER), mass FROM obj
  UNION ALL SELECT 'sublead_mu_p4_px', flag, CAST(least(greatest({sql_bin('pt * 3 * cos(phi)', 40, -200.0, 200.0)}, 1), 40) AS INTEGER), mass FROM obj
  UNION ALL SELECT 'nGoodJet', flag, CAST(least(greatest({sql_bin('(part % 13)', 7, 3.5, 10.5)}, 1), 7) AS INTEGER), mass FROM obj),
h AS (SELECT feature, flag, ix, sum(mass) AS s, sum(mass * mass) AS s2, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT feature, flag, ix, n, round(s / sum(s) OVER (PARTITION BY feature, flag), 6) AS content, round(sqrt(s2) / sum(s) OVER (PARTITION BY feature, flag), 6) AS error FROM h"""
)
def feature_histograms(spark, sf):
    """Feature shapes by group, outside values clipped into the outer bins."""
    axes = [Axis("pt", 10, 10.0, 60.0), *[Q.default_feature_axis(n) for n in ("jet_btag", "dr_pair", "sublead_mu_p4_px", "nGoodJet")]]
    rows = objects(spark, sf, "pt", "score", "phi", "part", "flag", "mass").withColumns(
        {"jet_btag": F.col("score"), "dr_pair": F.col("phi") + 3.14, "sublead_mu_p4_px": F.col("pt") * 3.0 * F.cos("phi"), "nGoodJet": F.col("part") % 13}
    )
    out = Q.feature_histograms(rows, axes, ["flag"], F.col("mass"))
    return out.select("feature", "flag", "ix", "n", r("content").alias("content"), r("error").alias("error"))


@query(
    f"""WITH {SQL_EV}, q AS (SELECT k, status, channel, row_number() OVER (PARTITION BY status, channel ORDER BY md5(concat_ws('|', '7', CAST(k AS VARCHAR))), k) AS rn, count(*) OVER (PARTITION BY status, channel) AS n FROM ev),
c AS (SELECT *, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS nv, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT) AS nt FROM q)
SELECT k, CASE WHEN rn <= n - nv - nt THEN 'train' WHEN rn <= n - nt THEN 'val' ELSE 'test' END AS split FROM c"""
)
def stratified_split(spark, sf):
    """Reproducible train / val / test split inside every (label, channel)."""
    out = S.stratified_split(heads(spark, sf, "status", "channel"), ["status", "channel"], ["k"], 0.15, 0.25, 7)
    return out.select("k", "split")


@query(
    f"""{SQL_S} SELECT k, CASE WHEN sw <= 0 THEN 'os' ELSE 'sr' END AS region FROM s WHERE (sw <= 0 AND channel IN ('1-URGENT', '2-HIGH', '5-LOW')) OR (sw > 0 AND channel IN ('2-HIGH', '3-MEDIUM'))"""
)
def sign_region_split(spark, sf):
    """Training and hold-out regions by sign and allowed channels."""
    df = signed(spark, sf).withColumn("ss", F.col("sw") > 0)
    return S.region_split(df, "ss", "channel", ["1-URGENT", "2-HIGH", "5-LOW"], ["2-HIGH", "3-MEDIUM"]).select("k", "region")


@query(
    f"""WITH {SQL_EV}, t AS (SELECT channel, sum(w) AS total FROM ev GROUP BY 1)
SELECT k, round(w * (2.5 * 17.5 * 1000 / total), 6) AS standard, round(w / (total * 2.5 * 17.5 * 1000) * 1000000000, 6) AS user_formula FROM ev JOIN t USING (channel)"""
)
def event_weight_modes(spark, sf):
    """The two event-weight conventions."""
    from eventloom.operators.scale import attach_totals

    ev = attach_totals(heads(spark, sf, "channel", "w"), ["channel"], total=F.sum("w"))
    args = (F.col("w"), F.lit(17.5), F.lit(2.5), F.col("total"))
    return ev.select(
        "k", r(W.event_weight(*args)).alias("standard"), r(W.event_weight(*args, mode="user_formula") * 1000000000).alias("user_formula")
    )


@query(
    f"""WITH {SQL_EV}, t AS (SELECT channel, sum(w) AS total, count(DISTINCT cust % 10) AS files, count(*) FILTER (w > 0.5) AS n, sum(w) FILTER (w > 0.5) AS s FROM ev GROUP BY 1)
SELECT channel, files, round(total, 9) AS sum_w, round(17.5 * 2 * 1000 / total, 6) AS factor, n AS n_events, round(s * (17.5 * 2 * 1000 / total), 5) AS yield FROM t"""
)
def channel_yields(spark, sf):
    """Files, sum of weights, factor, events and yield per channel."""
    ev = heads(spark, sf, "channel", "w", "cust")
    sel = F.col("w") > 0.5
    t = ev.groupBy("channel").agg(
        F.count_distinct(F.col("cust") % 10).alias("files"), F.sum("w").alias("total"), F.count_if(sel).alias("n_events"), F.sum(F.when(sel, F.col("w"))).alias("s")
    )
    f = W.mc_scale(F.lit(17.5), F.lit(2.0), F.col("total"))
    return t.select("channel", "files", r("total", 9).alias("sum_w"), r(f).alias("factor"), "n_events", r(F.col("s") * f, 5).alias("yield"))
