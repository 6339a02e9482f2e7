"""Feature tables, scoring, importance, training."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from eventloom.functions import vectors as V
from eventloom.operators import features as X
from eventloom.operators import importance as I
from eventloom.operators import quality as Q
from eventloom.operators import scoring as M
from eventloom.operators import splits as S
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, events, heads, nested, r, sql_dr, sql_folded, sql_mass, sql_p4, table

GOOD = "pt > 10 AND abs(eta) < 2.2"


def feature_events(spark, sf, *head):
    """Objects as jets and as muons (leading two by position)."""
    ev = events(spark, sf, ["pt", "eta", "phi", "mass", "score", "rel", "charge", "supp"], head)
    good = lambda o: o.withField("good", (o["pt"] > 10) & (F.abs(o["eta"]) < 2.2)).withField("source", F.when(o["supp"] % 2 == 0, 25).otherwise(6))
    return ev.withColumn("jets", F.transform("obj", good)).withColumn("muons", F.col("obj")).withColumns(
        {"lead_idx": F.when(F.size("obj") > 0, 0).otherwise(-1), "sublead_idx": F.when(F.size("obj") > 1, 1).otherwise(-1)}
    ).drop("obj")


MUON_MAP = {"miniPFRelIso_all": "rel", "jetRelIso": "mass", "jetDF": "score", "promptMVA": "score"}

SQL_TOP = f"""WITH {SQL_OBJ}, p AS (SELECT *, {sql_p4('o')} FROM obj o),
good AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS q, count(*) OVER (PARTITION BY k) AS c FROM p WHERE {GOOD}),
a AS (SELECT * FROM p WHERE i = 0), b AS (SELECT * FROM p WHERE i = 1),
e AS (SELECT k, count(*) AS n_good, count(*) FILTER (score > 0.1272) AS n_b, sum(pt) AS s, sum(pt) FILTER (score > 0.1272) AS sb, sum(sqrt(pt * cosh(eta) * pt * cosh(eta) + mass * mass)) AS en FROM good GROUP BY k HAVING count(*) >= 4)"""


def _t(n):
    return f"t{n} AS (SELECT * FROM good WHERE q = {n})"


@query(
    f"""{SQL_TOP}, {", ".join(_t(n) for n in range(1, 5))}
SELECT e.k, round(t1.px, 6) AS jet1_px, round(t4.pz, 6) AS jet4_pz, round(t2.score, 9) AS jet2_btag, round(t3.mass, 9) AS jet3_mass, round({sql_dr('t1', 'a')}, 6) AS jet1_dr_mu1, round({sql_dr('t4', 'b')}, 6) AS jet4_dr_mu2,
  round({sql_dr('t1', 't2')}, 6) AS bjet_dr_01, round({sql_dr('t2', 't4')}, 6) AS bjet_dr_13, round({sql_mass('t1', 't3')}, 4) AS bjet_m_02, round({sql_mass('t3', 't4')}, 4) AS bjet_m_23,
  round(a.py, 6) AS lead_mu_py, round(b.px, 6) AS sublead_mu_px, round(b.rel, 9) AS "sublead_mu_miniPFRelIso_all", round({sql_dr('a', 'b')}, 6) AS dimuon_dr, round({sql_mass('a', 'b')}, 4) AS dimuon_mass,
  CAST(n_good AS DOUBLE) AS "nGoodJet", CAST(n_b AS DOUBLE) AS "nBJet", round(s, 9) AS sumjet_pt, round(coalesce(sb, 0), 9) AS sumbjet_pt, round(s / en, 6) AS jet_cent, a.charge * b.charge > 0 AS "isSameSign"
FROM e JOIN t1 USING (k) JOIN t2 USING (k) JOIN t3 USING (k) JOIN t4 USING (k) JOIN a USING (k) JOIN b USING (k)"""
)
def flat_features(spark, sf):
    """The flat feature table of four best jets, pairs, two muons and sums."""
    out = X.extract_features(feature_events(spark, sf), ["k"], muon_fields=MUON_MAP)
    digits = {"jet2_btag": 9, "jet3_mass": 9, "bjet_m_02": 4, "bjet_m_23": 4, "dimuon_mass": 4, "sublead_mu_miniPFRelIso_all": 9, "sumjet_pt": 9, "sumbjet_pt": 9}
    names = (
        "jet1_px jet4_pz jet2_btag jet3_mass jet1_dr_mu1 jet4_dr_mu2 bjet_dr_01 bjet_dr_13 bjet_m_02 bjet_m_23 lead_mu_py sublead_mu_px "
        "sublead_mu_miniPFRelIso_all dimuon_dr dimuon_mass nGoodJet nBJet sumjet_pt sumbjet_pt jet_cent"
    ).split()
    return out.select("k", *[r(n, digits.get(n, 6)).alias(n) for n in names], "isSameSign")


def _sql_varied(name: str, factor: str) -> str:
    return f"SELECT '{name}' AS variation, k, sum(pt * {factor}) AS s, count(*) AS n FROM obj WHERE pt * {factor} > 20 GROUP BY k HAVING count(*) >= 2"


@query(
    f"""WITH {SQL_OBJ}, v AS ({_sql_varied('nominal', '1.0')} UNION ALL {_sql_varied('rel_up', '(1 + rel)')} UNION ALL {_sql_varied('rel_down', '(1 - rel)')} UNION ALL {_sql_varied('jer_up', '1.1')})
SELECT k, round(max(s) FILTER (variation = 'nominal'), 6) AS nominal, round(max(s) FILTER (variation = 'rel_up'), 7) AS rel_up, round(max(s) FILTER (variation = 'rel_down'), 7) AS rel_down, round(max(s) FILTER (variation = 'jer_up'), 6) AS jer_up FROM v GROUP BY k"""
)
def varied_features(spark, sf):
    """A feature under nominal and shifted jets, selection rebuilt per variation.

    The variations are a literal list per event, so the collections are built
    once and nothing is joined back."""
    ev = nested(spark, sf, "pt", "rel", "mass").withColumn("obj", F.transform("obj", lambda o: o.withField("jer", F.lit(1.0)).withField("jer_up", F.lit(1.1))))

    def summed(df, name):
        return df.withColumn(name, F.filter("obj", lambda o: o["pt"] > 20)).withColumn(
            name, F.when(F.size(name) >= 2, V.total(F.col(name), lambda o: o["pt"]))
        )

    df = ev.withColumn("kept", F.col("obj"))
    for name, args in {
        "nominal": {},
        "rel_up": {"source": "rel"},
        "rel_down": {"source": "rel", "direction": "down"},
        "jer_up": {"resolution": True, "scale_mass": True},
    }.items():
        df = summed(X.shift_jets(df.withColumn("obj", F.col("kept")), "obj", **args), name)
    df = df.filter(F.coalesce("nominal", "rel_up", "rel_down", "jer_up").isNotNull())
    return df.select("k", r("nominal", 6).alias("nominal"), r("rel_up", 7).alias("rel_up"), r("rel_down", 7).alias("rel_down"), r("jer_up", 6).alias("jer_up"))


@query(
    f"""WITH {SQL_OBJ}, p AS (SELECT *, {sql_p4('o')} FROM obj o), gm AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS g, count(*) OVER (PARTITION BY k) AS c FROM p WHERE rel < 0.06),
a AS (SELECT * FROM gm WHERE g = 1 AND c > 1), b AS (SELECT * FROM gm WHERE g = 2),
gj AS (SELECT p.* FROM p JOIN a USING (k) JOIN b USING (k) WHERE {GOOD.replace('pt', 'p.pt').replace('eta', 'p.eta')} AND {sql_folded('p', 'a')} > 0.4 AND {sql_folded('p', 'b')} > 0.4),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS q, count(*) OVER (PARTITION BY k) AS c FROM gj),
pr AS (SELECT x.k, x.q AS xq, y.q AS yq, row_number() OVER (PARTITION BY x.k ORDER BY x.q, y.q) - 1 AS no, x.supp % 2 = 0 AND y.supp % 2 = 0 AS ok, {sql_mass('x', 'y')} / 125 AS m, {sql_folded('x', 'y')} AS dr FROM t x JOIN t y ON x.k = y.k AND x.q < y.q AND y.q <= 4 WHERE x.c > 3)
SELECT k, coalesce(CAST(min(no) FILTER (ok) AS INTEGER), -1) AS label, round(max(m) FILTER (no = 0), 5) AS pair_m_01, round(max(dr) FILTER (no = 5), 6) AS pair_dr_23, CAST(any_value(n) AS INTEGER) AS n_good_jet, round(any_value(s), 9) AS sum_jet_pt, any_value(ss) AS pass_ss
FROM pr JOIN (SELECT k, count(*) AS n, sum(pt) AS s FROM gj GROUP BY k) USING (k) JOIN (SELECT a.k, a.c = 2 AND abs(a.charge + b.charge) = 2 AS ss FROM a JOIN b USING (k)) USING (k) GROUP BY k"""
)
def assignment_features(spark, sf):
    """Jet-pair assignment features with the label from object sources."""
    out = X.assignment_features(feature_events(spark, sf), ["k"], muon_good=lambda m: m["rel"] < 0.06)
    return out.select("k", "label", r("pair_m_01", 5).alias("pair_m_01"), r("pair_dr_23").alias("pair_dr_23"), "n_good_jet", r("sum_jet_pt", 9).alias("sum_jet_pt"), "pass_ss")


@query(
    f"""WITH {SQL_EV}, t AS (SELECT channel, sum(w) AS total FROM ev GROUP BY 1) SELECT k, round(17.5 * 2.5 * 1000 * w / total * (1 + block / 1000.0::DOUBLE), 6) AS weight FROM ev JOIN t USING (channel)"""
)
def yield_weights(spark, sf):
    """lumi * cross-section * 1000 * generator weight / sum * pile-up weight."""
    from eventloom.operators.scale import attach_totals

    ev = attach_totals(heads(spark, sf, "channel", "w", "block"), ["channel"], total=F.sum("w"))
    w = X.yield_weight(F.lit(17.5), F.lit(2.5), F.col("w"), F.col("total"), 1.0 + F.col("block") / 1000.0)
    return ev.select("k", r(w).alias("weight"))


@query(
    f"""{SQL_TOP}, {_t(1)}, {_t(2)} SELECT e.k, round(t1.px, 6) AS jet1_px, 0.0::DOUBLE AS bjet_dr_01, 0.0::DOUBLE AS dimuon_mass, CAST(n_good AS DOUBLE) AS "nGoodJet" FROM e JOIN t1 USING (k) JOIN t2 USING (k) JOIN a USING (k) JOIN b USING (k)"""
)
def feature_groups(spark, sf):
    """Some feature groups kept, the others set to zero."""
    X.check_groups(X.GROUPS, X.FEATURES)
    out = X.keep_groups(X.extract_features(feature_events(spark, sf), ["k"], muon_fields=MUON_MAP), X.GROUPS, ["jets", "event"], zero=True)
    return out.select("k", r("jet1_px").alias("jet1_px"), "bjet_dr_01", "dimuon_mass", "nGoodJet")


WEIGHTS_1 = [[round(((i * 5 + j * 3) % 11 - 5) / 10, 3) for j in range(8)] for i in range(6)]
BIAS_1 = [0.1, -0.2, 0.3, 0.0, -0.1, 0.2]
WEIGHTS_2 = [[round(((i * 7 + j * 2) % 9 - 4) / 5, 3) for j in range(6)] for i in range(3)]
BIAS_2 = [0.05, 0.0, -0.05]
LAYERS = [(WEIGHTS_1, BIAS_1), (WEIGHTS_2, BIAS_2)]
CLASSES = ["signal", "background", "other"]


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("int").alias("label"), F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double") * 10.0).alias("x")
    )


def _sql_dot(row, vec, bias):
    return "(" + " + ".join(f"{w}::DOUBLE * {vec}[{j + 1}]" for j, w in enumerate(row)) + f" + {bias}::DOUBLE)"


SQL_NET = f"""WITH x AS (SELECT vec_id, CAST(label AS INTEGER) AS label, list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE) * 10) AS x FROM embeddings),
h AS (SELECT *, [{", ".join(f"greatest({_sql_dot(w, 'x', b)}, 0.0::DOUBLE)" for w, b in LAYERS and zip(WEIGHTS_1, BIAS_1))}] AS h FROM x),
o AS (SELECT *, {", ".join(f"exp({_sql_dot(w, 'h', b)}) AS e{i}" for i, (w, b) in enumerate(zip(WEIGHTS_2, BIAS_2)))} FROM h),
s AS (SELECT *, e0 / (e0 + e1 + e2) AS s0, e1 / (e0 + e1 + e2) AS s1, e2 / (e0 + e1 + e2) AS s2 FROM o)"""


@query(
    SQL_NET
    + """ SELECT vec_id, round(s0, 6) AS s0, round(s1, 6) AS s1, round(greatest(s0, s1, s2), 6) AS best_score,
  CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'signal' WHEN s1 >= s2 THEN 'background' ELSE 'other' END AS class_name, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS predicted FROM s"""
)
def network_scores(spark, sf):
    """Batch scoring of a dense network: probabilities, best class, its name."""
    out = M.with_prediction(vectors(spark, sf), F.col("x"), LAYERS, CLASSES)
    return out.select(
        "vec_id",
        r(F.get("scores", F.lit(0))).alias("s0"),
        r(F.get("scores", F.lit(1))).alias("s1"),
        r("best_score").alias("best_score"),
        "class_name",
        "predicted",
    )


@query(
    SQL_NET.replace("CAST(v AS DOUBLE) * 10) AS x FROM embeddings", "CAST(v AS DOUBLE) * 10 * f) AS x, variation FROM embeddings, (VALUES ('nominal', 1.0::DOUBLE), ('scale_up', 1.1), ('scale_down', 0.9)) t(variation, f)")
    + """ SELECT vec_id, round(max(s0) FILTER (variation = 'nominal'), 6) AS nominal, round(max(s0) FILTER (variation = 'scale_up'), 6) AS scale_up, round(max(s0) FILTER (variation = 'scale_down'), 6) AS scale_down FROM s GROUP BY vec_id"""
)
def network_scores_varied(spark, sf):
    """Scores under every variation: the variations are columns of one row, so
    one pass scores them all and no pivot is needed."""
    df = vectors(spark, sf)
    scaled = lambda f: F.transform("x", lambda v: v * f)
    for name, f in (("nominal", 1.0), ("scale_up", 1.1), ("scale_down", 0.9)):
        df = df.withColumn(name, F.get(M.dense_scores(scaled(f), LAYERS), F.lit(0)))
    return df.select("vec_id", *[r(n).alias(n) for n in ("nominal", "scale_up", "scale_down")])


LINEAR = [0.7, -0.4, 0.3]


@query(
    f"""WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, CAST(embedding[3] AS DOUBLE) AS f2, label % 2 = 0 AS truth, 1.0::DOUBLE + abs(CAST(embedding[4] AS DOUBLE)) AS w FROM embeddings),
ra AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws('|', '5a', CAST(vec_id AS VARCHAR))), vec_id) AS rn FROM b), rb AS (SELECT f0, row_number() OVER (ORDER BY md5(concat_ws('|', '5b', CAST(vec_id AS VARCHAR))), vec_id) AS rn FROM b),
p AS (SELECT b.vec_id, rb.f0, b.f1, b.f2, truth, w FROM b JOIN ra USING (vec_id) JOIN rb USING (rn)),
c AS (SELECT sum(CASE WHEN (0.7 * f0 - 0.4 * f1 + 0.3 * f2 > 0) = truth THEN w ELSE 0 END) / sum(w) AS acc FROM b), d AS (SELECT sum(CASE WHEN (0.7 * f0 - 0.4 * f1 + 0.3 * f2 > 0) = truth THEN w ELSE 0 END) / sum(w) AS acc FROM p)
SELECT 'f0' AS feature, round(c.acc, 6) AS baseline, round(d.acc, 6) AS permuted, round(greatest(0, c.acc - d.acc), 6) AS importance FROM c, d"""
)
def permutation_importance(spark, sf):
    """Drop of the accuracy after one feature is permuted over all rows."""
    e = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    df = e.select("vec_id", *[at(i).alias(f"f{i}") for i in range(3)], (F.col("label") % 2 == 0).alias("truth"), (1.0 + F.abs(at(3))).alias("w"))

    def accuracy(d):
        d = d.withColumn("pred", M.linear_margin([F.col(f"f{i}") for i in range(3)], LINEAR) > 0)
        return Q.accuracy(d, "truth", "pred", "w").select("accuracy")

    base = accuracy(df).scalar()
    out = accuracy(S.permute(df, ["vec_id"], ["f0"], 5)).select(F.col("accuracy").alias("p")).withColumn("b", base)
    return out.select(
        F.lit("f0").alias("feature"), r("b").alias("baseline"), r("p").alias("permuted"), r(F.greatest(F.lit(0.0), F.col("b") - F.col("p"))).alias("importance")
    )


@query(
    """WITH m AS (SELECT CAST(label AS INTEGER) AS label, 'first' AS run, avg(CAST(embedding[1] AS DOUBLE)) AS v FROM embeddings WHERE label < 8 GROUP BY label UNION ALL SELECT CAST(label AS INTEGER), 'second', avg(CAST(embedding[2] AS DOUBLE)) FROM embeddings WHERE label > 1 GROUP BY label)
SELECT label, round(max(v) FILTER (run = 'first'), 6) AS first, round(max(v) FILTER (run = 'second'), 6) AS second FROM m GROUP BY label"""
)
def run_comparison(spark, sf):
    """Metric tables of several runs side by side."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("label"), F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    one = e.filter("label < 8").groupBy("label").agg(F.avg("a").alias("v")).withColumn("run", F.lit("first"))
    two = e.filter("label > 1").groupBy("label").agg(F.avg("b").alias("v")).withColumn("run", F.lit("second"))
    wide = one.unionByName(two).groupBy("label").pivot("run", ["first", "second"]).agg(F.max("v"))
    return wide.select("label", r("first").alias("first"), r("second").alias("second"))


def labelled_vectors(spark, sf):
    """Vectors by component with three labels and a weight; names of the components."""
    e = table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"f{i}" for i in range(width)]
    label = F.least(F.col("label"), F.lit(2)).cast("double")
    df = e.select(label.alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return df.withColumn("w", F.when(F.col("label") == 2, 0.3).otherwise(F.lit(1.0))), names


@query()
def trained_classifier(spark, sf):
    """Multinomial regression with per-event weights, trained and scored."""
    df, names = labelled_vectors(spark, sf)
    model = M.train_multinomial(df, names, "label", "w", max_iter=30)
    scored = model.transform(df).select(F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))
    return scored.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SQL_OBJ}, p AS (SELECT *, {sql_p4('o')} FROM obj o), a AS (SELECT * FROM p WHERE i = 0), b AS (SELECT * FROM p WHERE i = 1)
SELECT a.k, round((a.px / 100) * 146.2224842392, 6) AS px, round(a.mass / 10 * 10.6231408469 + 14.4182656164, 6) AS mass, round(a.score * 0.2690405989 + 0.7925129098, 6) AS score, round(a.pt / 50 * 79.3298290615 + 97.1714688314, 6) AS pt, round({sql_folded('a', 'b')}, 6) AS dr FROM a JOIN b USING (k)"""
)
def undone_standardisation(spark, sf):
    """Standardised features restored, distances folded again."""
    ev = nested(spark, sf, "pt", "eta", "phi", "mass", "score").filter(F.size("obj") >= 2).withColumn("p", V.with_p4(F.col("obj")))
    ev = ev.select("k", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    a, b = F.col("a"), F.col("b")
    full = X.undo_standardisation(a["p4"]["px"] / 100.0, a["p4"]["py"], a["p4"]["pz"], a["mass"] / 10.0, a["score"])
    polar = X.undo_standardisation_polar(a["pt"] / 50.0, a["mass"], a["score"])
    deta = a["eta"] - b["eta"]
    raw = F.sqrt(deta * deta + F.pow(a["phi"] - b["phi"], 2))
    again = X.refold_distance(raw, X.momentum_eta(a["p4"]) - X.momentum_eta(b["p4"]))
    return ev.select("k", r(full["px"]).alias("px"), r(full["mass"]).alias("mass"), r(full["score"]).alias("score"), r(polar["pt"]).alias("pt"), r(again).alias("dr"))


@query(
    f"""WITH {SQL_OBJ}, a AS (SELECT *, CAST(CASE supp % 5 WHEN 0 THEN 6 WHEN 1 THEN 25 ELSE 500 + part % 100 END AS INTEGER) AS code FROM obj),
t AS (SELECT a.k, a.i, a.eta, a.phi, a.code >= 500 AND NOT coalesce(c.code >= 500, FALSE) AS terminal FROM a LEFT JOIN a c ON a.k = c.k AND c.i = a.i + 1),
o AS (SELECT t.k, t.i, t.eta, t.phi, coalesce(arg_max(u.code, u.i), 1) AS src FROM t LEFT JOIN a u ON t.k = u.k AND u.i < t.i AND u.code IN (6, 25) WHERE terminal GROUP BY ALL),
j AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) - 1 AS q, count(*) OVER (PARTITION BY k) AS c FROM a),
n AS (SELECT k, q, arg_min(src, (d, oi)) AS src FROM (SELECT j.k, j.q, o.i AS oi, o.src, {sql_dr('j', 'o')} AS d FROM j JOIN o ON j.k = o.k WHERE j.q < 4) WHERE d < 0.8 GROUP BY k, q),
s AS (SELECT j.k, j.q, coalesce(n.src, -1) AS src FROM j LEFT JOIN n USING (k, q) WHERE j.q < 4 AND j.c >= 4),
pr AS (SELECT x.k, x.src = 25 AND y.src = 25 AS ok, row_number() OVER (PARTITION BY x.k ORDER BY x.q, y.q) - 1 AS no FROM s x JOIN s y ON x.k = y.k AND x.q < y.q),
h AS (SELECT k, CAST(count(*) FILTER (src = 25) AS INTEGER) AS n_higgs FROM s GROUP BY k)
SELECT k, coalesce(CAST(min(no) FILTER (ok) AS INTEGER), -1) AS label, any_value(n_higgs) AS n_higgs FROM pr JOIN h USING (k) GROUP BY k"""
)
def association_labels(spark, sf):
    """Label of the pair of leading jets that both come from code 25."""
    ev = nested(spark, sf, "eta", "phi", "score", "part", "supp").filter(F.size("obj") >= 4)
    code = lambda o: F.when(o["supp"] % 5 == 0, 6).when(o["supp"] % 5 == 1, 25).otherwise(500 + o["part"] % 100).cast("int")
    ev = ev.withColumn("codes", F.transform("obj", code)).withColumn("up", F.transform("obj", lambda o, i: i - 1))
    ev = ev.withColumn("origin", V.terminal_sources(F.col("codes"), F.col("up")))
    ev = ev.withColumn("had", F.zip_with("obj", "origin", lambda o, s: F.struct(o["eta"].alias("eta"), o["phi"].alias("phi"), s.alias("src"))))
    ev = ev.withColumn("top", V.top_by(F.col("obj"), "score", 4))
    ev = ev.withColumn("at", V.nearest(F.col("top"), F.col("had"), 0.8, lambda h: h["src"] != 0))
    ev = ev.withColumn("src", F.transform("at", lambda i: F.coalesce(F.get("origin", i), F.lit(-1))))
    src = [F.get("src", F.lit(i)) for i in range(4)]
    pairs = F.array(*[(src[i] == 25) & (src[j] == 25) for i in range(4) for j in range(i + 1, 4)])
    return ev.select("k", V.first_true(pairs).alias("label"), F.size(F.filter("src", lambda s: s == 25)).alias("n_higgs"))


@query(
    f"""{SQL_TOP}, {_t(1)}, {_t(2)}, {_t(3)}, {_t(4)} SELECT e.k, [round(t1.score, 9), round(t2.score, 9), round(t3.score, 9), round(t4.score, 9)] AS scores, round(s, 9) AS sumjet_pt
FROM e JOIN t1 USING (k) JOIN t2 USING (k) JOIN t3 USING (k) JOIN t4 USING (k) JOIN a USING (k) JOIN b USING (k) WHERE a.charge * b.charge > 0 AND t1.supp % 2 = 0"""
)
def training_rows(spark, sf):
    """Matched same-sign rows, columns split into node and global blocks."""
    ev = feature_events(spark, sf).withColumn("best_supp", F.get(V.top_by(F.filter("jets", lambda j: j["good"]), "score", 1), F.lit(0))["supp"])
    out = X.extract_features(ev, ["k", "best_supp"], muon_fields=MUON_MAP).filter(F.col("isSameSign") & (F.col("best_supp") % 2 == 0))
    node = F.array(*[r(f"jet{n}_btag", 9) for n in range(1, 5)])
    return out.select("k", node.alias("scores"), r("sumjet_pt", 9).alias("sumjet_pt"))


#: relative jet sources as multiples of one, the muon pt fields, and a network for all features
JET_SOURCES = {f"src{n}": n / 4 for n in range(1, 12)}
VARIATIONS = X.jet_variations(list(JET_SOURCES), True, ("pt_scale_up", "pt_scale_dn"), ("pt_resol_up", "pt_resol_dn"))
WIDE_1 = [[round(((i * 5 + j * 3) % 11 - 5) / 2000, 4) for j in range(len(X.FEATURES))] for i in range(6)]
WIDE_LAYERS = [(WIDE_1, BIAS_1), (WEIGHTS_2, BIAS_2)]


def _sql_variations() -> str:
    rows = [("nominal", "pt", "pt")]
    rows += [(f"{n}_{d}", f"pt * (1 {s} rel * {f}::DOUBLE)", "pt") for n, f in JET_SOURCES.items() for d, s in (("up", "+"), ("down", "-"))]
    rows += [("JER_corr_up", "pt / (1 + score / 20) * (1.1::DOUBLE + score / 20)", "pt"), ("JER_corr_down", "pt / (1 + score / 20) * (0.9::DOUBLE + score / 20)", "pt")]
    rows += [(f"MuonRoch_{n}", "pt", f"pt * {f}") for n, f in (("scale_up", "(1 + rel / 10)"), ("scale_down", "(1 - rel / 10)"), ("resol_up", "(1 + score / 50)"), ("resol_down", "(1 - score / 50)"))]
    assert [n for n, _, _ in rows] == [v.name for v in VARIATIONS]
    return " UNION ALL ".join(f"SELECT *, '{n}' AS v, {jet} AS jpt, {mu} AS mpt FROM x" for n, jet, mu in rows)


def _sql_features() -> dict[str, str]:
    """Every feature over the jets t1 to t4, the muons a and b and the sums e."""
    out = {}
    for n in range(1, 5):
        out |= {f"jet{n}_{c}": f"t{n}.{c}" for c in ("px", "py", "pz")}
        out |= {f"jet{n}_mass": f"t{n}.mass", f"jet{n}_btag": f"t{n}.score", f"jet{n}_dr_mu1": sql_dr(f"t{n}", "a"), f"jet{n}_dr_mu2": sql_dr(f"t{n}", "b")}
    for i, j in X.PAIRS:
        out |= {f"bjet_dr_{i}{j}": sql_dr(f"t{i + 1}", f"t{j + 1}"), f"bjet_m_{i}{j}": sql_mass(f"t{i + 1}", f"t{j + 1}")}
    for who, m in (("lead", "a"), ("sublead", "b")):
        out |= {f"{who}_mu_{c}": f"{m}.{c}" for c in ("px", "py", "pz")} | {f"{who}_mu_{f}": f"{m}.{field}" for f, field in MUON_MAP.items()}
    out |= {"dimuon_dr": sql_dr("a", "b"), "dimuon_mass": sql_mass("a", "b")}
    out |= {"nGoodJet": "CAST(n_good AS DOUBLE)", "nBJet": "CAST(n_b AS DOUBLE)", "sumjet_pt": "s", "sumbjet_pt": "coalesce(sb, 0)", "jet_cent": "s / en"}
    assert set(out) == set(X.FEATURES)
    return {f: out[f] for f in X.FEATURES}


def sql_feature_tables(variations: str, jet_pt: float) -> str:
    """CTEs up to the row of jets, muons and sums per event and variation; ``variations``
    selects from x and adds v, jpt and mpt."""
    jets = f"jt AS (SELECT k, v, i, score, eta, phi, jpt AS pt, mass * jpt / greatest(pt, 1e-6) AS mass FROM vo WHERE jpt > {jet_pt} AND abs(eta) < 2.2)"
    good = f"good AS (SELECT *, {sql_p4('o')}, row_number() OVER (PARTITION BY k, v ORDER BY score DESC, i) AS q, count(*) OVER (PARTITION BY k, v) AS c FROM jt o)"
    muons = f"mu AS (SELECT *, {sql_p4('o')} FROM (SELECT k, v, i, mpt AS pt, eta, phi, mass, score, rel, charge FROM vo WHERE i < 2) o)"
    sums = "e AS (SELECT k, v, count(*) AS n_good, count(*) FILTER (score > 0.1272) AS n_b, sum(pt) AS s, sum(pt) FILTER (score > 0.1272) AS sb, sum(sqrt(pt * cosh(eta) * pt * cosh(eta) + mass * mass)) AS en FROM good GROUP BY k, v HAVING count(*) >= 4)"
    tops = ", ".join(f"t{n} AS (SELECT * FROM good WHERE q = {n})" for n in range(1, 5))
    return f"WITH {SQL_OBJ}, x AS (SELECT * FROM obj), vo AS ({variations}), {jets}, {good}, {muons}, {sums}, {tops}, a AS (SELECT * FROM mu WHERE i = 0), b AS (SELECT * FROM mu WHERE i = 1)"


_JOINED = "e JOIN t1 USING (k, v) JOIN t2 USING (k, v) JOIN t3 USING (k, v) JOIN t4 USING (k, v) JOIN a USING (k, v) JOIN b USING (k, v)"


@query(
    sql_feature_tables("SELECT *, 'nominal' AS v, pt AS jpt, pt AS mpt FROM x", 10.0)
    + " SELECT e.k, "
    + ", ".join(f'round({x}, 5) AS "{f}"' for f, x in _sql_features().items())
    + f' , a.charge * b.charge > 0 AS "isSameSign" FROM {_JOINED}'
)
def flat_features_all(spark, sf):
    """All 61 features of the flat table."""
    out = X.extract_features(feature_events(spark, sf), ["k"], muon_fields=MUON_MAP)
    return out.select("k", *[r(f, 5).alias(f) for f in X.FEATURES], "isSameSign")


def _varied_events(spark, sf):
    """Objects that are jets and muons (leading two by position)."""
    ev = events(spark, sf, ["pt", "eta", "phi", "mass", "score", "rel"], ["status"])
    has = lambda n: F.when(F.size("obj") > n, n).otherwise(-1)
    return ev.select("k", "status", "obj", has(0).alias("lead_idx"), has(1).alias("sublead_idx"))


def _varied_jet(o):
    """A jet with eleven sources and a resolution."""
    jer = 1.0 + o["score"] / 20.0
    parts = [o[c].alias(c) for c in ("pt", "eta", "phi", "mass", "score")] + [(o["rel"] * f).alias(s) for s, f in JET_SOURCES.items()]
    return F.struct(*parts, jer.alias("jer"), (jer + 0.1).alias("jer_up"), (jer - 0.1).alias("jer_down"), (F.abs(o["eta"]) < 2.2).alias("fit"))


def _varied_muon(o):
    """A muon with four other pt."""
    parts = [o[c].alias(c) for c in ("pt", "eta", "phi", "mass", "score", "rel")]
    moved = {"pt_scale_up": 1.0 + o["rel"] / 10.0, "pt_scale_dn": 1.0 - o["rel"] / 10.0, "pt_resol_up": 1.0 + o["score"] / 50.0, "pt_resol_dn": 1.0 - o["score"] / 50.0}
    return F.struct(*parts, *[(o["pt"] * f).alias(n) for n, f in moved.items()])


def _sql_wide_net() -> str:
    hidden = ", ".join(f"greatest({_sql_dot(w, 'x', b)}, 0.0::DOUBLE)" for w, b in zip(WIDE_1, BIAS_1))
    outs = ", ".join(f"exp({_sql_dot(w, 'h', b)}) AS e{i}" for i, (w, b) in enumerate(zip(WEIGHTS_2, BIAS_2)))
    return f"""{sql_feature_tables(_sql_variations(), 25.0)}, fx AS (SELECT e.k, e.v, [{", ".join(_sql_features().values())}] AS x FROM {_JOINED} JOIN orders ON o_orderkey = e.k WHERE e.v = 'nominal' OR o_orderstatus <> 'P'),
hx AS (SELECT k, v, [{hidden}] AS h FROM fx), ox AS (SELECT k, v, {outs} FROM hx)
SELECT k, v AS variation, round(e0 / (e0 + e1 + e2), 6) AS signal, round(e1 / (e0 + e1 + e2), 6) AS background, round(e2 / (e0 + e1 + e2), 6) AS other FROM ox"""


@query(_sql_wide_net())
def scores_under_variations(spark, sf):
    """Scores of a network on all 61 features under nominal, eleven jet sources, the jet
    resolution and the muon pt, up and down; one status plays data (nominal only)."""
    objects = {"jets": "obj", "muons": "obj", "as_jet": _varied_jet, "as_muon": _varied_muon}
    vectors = partial(X.varied_vectors, variations=VARIATIONS, is_data=F.col("status") == "P", jet_pt=25.0, scale_mass=True, muon_fields=MUON_MAP, **objects)
    scored = M.scores_by_variation(_varied_events(spark, sf), vectors, WIDE_LAYERS, [v.name for v in VARIATIONS])
    rows = scored.select("k", F.explode_outer("scores").alias("variation", "p")).where("p IS NOT NULL")
    return rows.select("k", "variation", *[r(F.get("p", F.lit(i))).alias(c) for i, c in enumerate(CLASSES)])


def _sql_assignment() -> dict[str, str]:
    out = {}
    for n in range(1, 5):
        out |= {f"jet{n}_{c}": f"t{n}.{c}" for c in ("px", "py", "pz", "mass", "score")}
        out |= {f"jet{n}_dr_mu1": sql_folded(f"t{n}", "a"), f"jet{n}_dr_mu2": sql_folded(f"t{n}", "b")}
    for i, j in X.PAIRS:
        out |= {f"pair_dr_{i}{j}": sql_folded(f"t{i + 1}", f"t{j + 1}"), f"pair_m_{i}{j}": f"{sql_mass(f't{i + 1}', f't{j + 1}')} / 125"}
    return out | {"sum_jet_pt": "s", "sum_bjet_pt": "coalesce(sb, 0)"}


@query(
    f"""WITH {SQL_OBJ}, p AS (SELECT *, {sql_p4('o')} FROM obj o), gm AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS g, count(*) OVER (PARTITION BY k) AS c FROM p WHERE rel < 0.06),
a AS (SELECT * FROM gm WHERE g = 1 AND c > 1), b AS (SELECT * FROM gm WHERE g = 2),
gj AS (SELECT p.* FROM p JOIN a USING (k) JOIN b USING (k) WHERE {GOOD.replace('pt', 'p.pt').replace('eta', 'p.eta')} AND {sql_folded('p', 'a')} > 0.4 AND {sql_folded('p', 'b')} > 0.4),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS q FROM gj), {", ".join(f"t{n} AS (SELECT * FROM t WHERE q = {n})" for n in range(1, 5))},
e AS (SELECT k, count(*) AS n, count(*) FILTER (score > 0.1272) AS nb, sum(pt) AS s, sum(pt) FILTER (score > 0.1272) AS sb FROM gj GROUP BY k HAVING count(*) > 3)
SELECT e.k, {", ".join(f'round({x}, 5) AS {n}' for n, x in _sql_assignment().items())}, CAST(e.n AS INTEGER) AS n_good_jet, CAST(e.nb AS INTEGER) AS n_bjet, CAST(a.c AS INTEGER) AS n_good_muon, a.c = 2 AND abs(a.charge + b.charge) = 2 AS pass_ss,
  CAST(CASE {" ".join(f"WHEN t{i + 1}.supp % 2 = 0 AND t{j + 1}.supp % 2 = 0 THEN {no}" for no, (i, j) in enumerate(X.PAIRS))} ELSE -1 END AS INTEGER) AS label
FROM e JOIN t1 USING (k) JOIN t2 USING (k) JOIN t3 USING (k) JOIN t4 USING (k) JOIN a USING (k) JOIN b USING (k)"""
)
def assignment_features_all(spark, sf):
    """All outputs of the jet-pair assignment."""
    out = X.assignment_features(feature_events(spark, sf), ["k"], muon_good=lambda m: m["rel"] < 0.06)
    numbers = [r(n, 5).alias(n) for n in _sql_assignment()]
    return out.select("k", *numbers, "n_good_jet", "n_bjet", "n_good_muon", "pass_ss", "label")


#: seven groups of all components, and a network for them
EMBEDDING = 64
PARTS = {f"part{n}": list(range(lo, hi)) for n, (lo, hi) in enumerate(((0, 10), (10, 20), (20, 30), (30, 40), (40, 48), (48, 56), (56, 64)))}
LONG_1 = [[round(((i * 13 + j * 7) % 17 - 8) / 4, 3) for j in range(EMBEDDING)] for i in range(6)]
LONG_LAYERS = [(LONG_1, BIAS_1), (WEIGHTS_2, BIAS_2)]


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "]"


def _sql_importance(repeats: int, seed: int) -> str:
    """The same ranks, bijections and network, with one step per round."""
    plans = [(scope, g, lo[0], lo[-1] + 1) for scope in (0, 1) for g, lo in PARTS.items() for _ in range(repeats)]
    rows = ", ".join(f"({no}, {scope}, '{g}', {lo}, {hi}, {[list(t) for t in I.round_numbers(no, seed)]})" for no, (scope, g, lo, hi) in enumerate(plans))
    steps = []
    for k in range(1, I.ROUNDS + 1):
        other = f"((rounds[{k}][1] - y) % m + m) % m"
        u = f"(((greatest(y, {other}) % {I.PRIME}) * rounds[{k}][2] + rounds[{k}][3]) % {I.PRIME})"
        steps.append(f"y{k} AS (SELECT * REPLACE (CASE WHEN ({u} * {u}) % {I.PRIME} % 2 = 1 THEN {other} ELSE y END AS y) FROM {f'y{k - 1}' if k > 1 else 'sent'})")
    hidden = lambda x: "[" + ", ".join(f"greatest(list_dot_product({x}, {_sql_list(w)}) + {b}::DOUBLE, 0.0::DOUBLE)" for w, b in zip(LONG_1, BIAS_1)) + "]"
    outs = lambda h: ", ".join(f"list_dot_product({h}, {_sql_list(w)}) + {b}::DOUBLE AS o{i}" for i, (w, b) in enumerate(zip(WEIGHTS_2, BIAS_2)))
    pick = "CASE WHEN o0 >= o1 AND o0 >= o2 THEN 0 WHEN o1 >= o2 THEN 1 ELSE 2 END"
    return f"""WITH e AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS x, CAST(label % 3 AS INTEGER) AS c, 1.0::DOUBLE + abs(CAST(embedding[4] AS DOUBLE)) AS w FROM embeddings),
z AS (SELECT c, count(*) AS n, sum(count(*)) OVER (ORDER BY c) - count(*) AS first, sum(count(*)) OVER () AS total FROM e GROUP BY c),
d AS (SELECT e.*, n, CAST(first AS BIGINT) AS first, CAST(total AS BIGINT) AS total, row_number() OVER (PARTITION BY e.c ORDER BY md5(concat_ws('|', '{seed}', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS place FROM e JOIN z USING (c)),
plan(no, scope, grp, lo, hi, rounds) AS (VALUES {rows}),
sent AS (SELECT no, scope, grp, lo, hi, rounds, x, CASE WHEN scope = 1 THEN n ELSE total END AS m, CASE WHEN scope = 1 THEN first ELSE 0 END AS base, CASE WHEN scope = 1 THEN place ELSE first + place END AS y FROM d, plan),
{", ".join(steps)},
v AS (SELECT no, scope, grp, d.c, d.w, list_concat(list_concat(d.x[1:lo], s.x[lo + 1:hi]), d.x[hi + 1:]) AS x FROM y{I.ROUNDS} s JOIN d ON d.first + d.place = base + y),
u AS (SELECT -1 AS no, -1 AS scope, '' AS grp, c, w, x FROM d UNION ALL SELECT * FROM v),
h AS (SELECT no, scope, grp, c, w, {hidden('x')} AS h FROM u), o AS (SELECT no, scope, grp, c, w, {outs('h')} FROM h),
r AS (SELECT no, scope, grp, c, sum(CASE WHEN {pick} = c THEN w ELSE 0 END) AS good, sum(w) AS w FROM o GROUP BY ALL),
t AS (SELECT 'all' AS scope, grp, sum(good) / {repeats} / sum(w) * {repeats} AS p FROM r WHERE scope = 0 GROUP BY grp UNION ALL SELECT 'class ' || CAST(c AS VARCHAR), grp, sum(good) / sum(w) FROM r WHERE scope = 1 GROUP BY c, grp),
b AS (SELECT 'all' AS scope, sum(good) / sum(w) AS b FROM r WHERE scope = -1 UNION ALL SELECT 'class ' || CAST(c AS VARCHAR), good / w FROM r WHERE scope = -1)
SELECT t.scope, grp AS "group", round(b, 9) AS baseline, round(p, 9) AS permuted, round(greatest(0, b - p), 9) AS importance FROM t JOIN b USING (scope)"""


@query(_sql_importance(5, 3))
def group_importance(spark, sf):
    """Importance of seven groups of all components: five repeats, all rows and per
    class, one ranking."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("truth"), (1.0 + F.abs(F.get("embedding", F.lit(3)).cast("double"))).alias("w"))
    out = I.group_importance(e, ["vec_id"], "embedding", "truth", "w", LONG_LAYERS, PARTS, 5, 3)
    return out.select("scope", "group", *[r(c, 9).alias(c) for c in ("baseline", "permuted", "importance")])
