"""Functions on object collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import kinematics as K
from eventloom.functions import vectors as V
from eventloom.plans.registry import query
from eventloom.plans.tables import (
    SQL_OBJ,
    nested,
    r,
    sql_dphi,
    sql_dr,
    sql_folded,
    sql_mass,
    sql_p4,
)

SQL_P4 = f"WITH {SQL_OBJ}, p AS (SELECT *, {sql_p4('o')} FROM obj o)"


@query(
    f"""WITH {SQL_OBJ}, m AS (SELECT *, pt > 20 AND abs(eta) < 2.0 AND (charge > 0 OR score >= 0.5) AS ok FROM obj)
SELECT k, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS INTEGER) AS n_ok, list(i ORDER BY i) FILTER (ok) AS at,
  CAST(max(CASE WHEN rn = 3 THEN i END) AS INTEGER) AS third, coalesce(CAST(min(CASE WHEN ok THEN i END) AS INTEGER), -1) AS first_ok,
  round(sum(CASE WHEN ok THEN pt END), 9) AS sum_ok
FROM (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY k, ok ORDER BY i) END AS rn FROM m) GROUP BY k"""
)
def masks_and_positions(spark, sf):
    """Element-wise conditions, selection by mask, positions, counts, k-th selected."""
    ev = nested(spark, sf, "pt", "eta", "charge", "score")
    ok = V.mask(F.col("obj"), lambda o: (o["pt"] > 20) & (F.abs(o["eta"]) < 2.0) & ((o["charge"] > 0) | (o["score"] >= 0.5)))
    ev = ev.withColumn("ok", ok).withColumn("at", V.positions(F.col("ok")))
    n = V.count_true(F.col("ok"))
    return ev.select(
        "k",
        n.alias("n_ok"),
        F.when(n > 0, F.col("at")).alias("at"),
        V.kth_position(F.col("ok"), 2).alias("third"),
        V.first_true(F.col("ok")).alias("first_ok"),
        r(F.when(n > 0, V.total(V.select_by_mask(F.col("obj"), F.col("ok")), lambda o: o["pt"])), 9).alias("sum_ok"),
    )


@query(
    f"""WITH {SQL_OBJ}, j AS (SELECT a.k, a.i, a.part, b.pt, b.eta AS eta, b.phi AS phi, a.eta AS aeta, a.phi AS aphi, b.score FROM obj a LEFT JOIN obj b ON a.k = b.k AND b.i = a.i - 1)
SELECT k, i, round(coalesce(pt, -999.0), 9) AS linked_pt,
  round(CASE WHEN pt IS NULL THEN 999.0 ELSE sqrt((aeta - eta) * (aeta - eta) + {sql_dphi('aphi', 'phi')} * {sql_dphi('aphi', 'phi')}) END, 6) AS linked_dr,
  CAST(CASE WHEN score >= 0.5 THEN i - 1 ELSE -1 END AS INTEGER) AS good_link, (part >> 3) & 1 = 1 AS bit3
FROM j"""
)
def linked_objects(spark, sf):
    """Gather through links with sentinels, links dropped by a mask, bit tests."""
    ev = nested(spark, sf, "pt", "eta", "phi", "score", "part").withColumn(
        "obj", F.transform("obj", lambda o, i: o.withField("link", i - 1))
    )
    obj = F.col("obj")
    good = V.mask(obj, lambda o: o["score"] >= 0.5)
    out = ev.select(
        "k",
        F.posexplode_outer(
            V.zip_records(
                pt=V.linked_field(obj, "link", obj, "pt", -999.0),
                dr=V.linked_distance(obj, "link", obj),
                link=V.keep_link(F.transform(obj, lambda o: o["link"]), good),
                bit=V.mask(obj, lambda o: V.has_bit(o["part"], 3)),
            )
        ).alias("i", "x"),
    )
    return out.select(
        "k",
        "i",
        r("x.pt", 9).alias("linked_pt"),
        r("x.dr").alias("linked_dr"),
        F.col("x.link").alias("good_link"),
        F.col("x.bit").alias("bit3"),
    )


@query(
    f"""WITH {SQL_OBJ}, a AS (SELECT k, eta, phi FROM obj WHERE i = 0)
SELECT o.k, o.i, round({sql_dr('o', 'a')}, 6) AS dr, round(abs({sql_dphi('o.phi', 'a.phi')}), 6) AS dphi, round({sql_folded('o', 'a')}, 6) AS folded
FROM obj o JOIN a ON o.k = a.k"""
)
def distances(spark, sf):
    """Distance of every object from the first, in both angle conventions."""
    ev = nested(spark, sf, "eta", "phi").withColumn("a", F.get("obj", F.lit(0)))
    a = F.col("a")
    out = ev.select(
        "k",
        F.posexplode_outer(
            F.zip_with(
                "obj",
                V.distances_from(F.col("obj"), a["eta"], a["phi"]),
                lambda o, dr: F.struct(
                    dr.alias("dr"),
                    F.abs(K.delta_phi(o["phi"], a["phi"])).alias("dphi"),
                    K.folded_delta_r(o["eta"], o["phi"], a["eta"], a["phi"]).alias("folded"),
                ),
            )
        ).alias("i", "x"),
    )
    return out.select("k", "i", r("x.dr").alias("dr"), r("x.dphi").alias("dphi"), r("x.folded").alias("folded"))


@query(
    f"""WITH {SQL_OBJ}, m AS (SELECT * FROM obj WHERE charge > 0),
d AS (SELECT j.k, j.i, j.pt, min({sql_dr('m', 'j')}) AS near FROM obj j LEFT JOIN m ON j.k = m.k AND m.i <> j.i GROUP BY j.k, j.i, j.pt)
SELECT k, i, round(CASE WHEN pt > 20 THEN least(coalesce(near, 999.0), 999.0) ELSE 0.0 END, 6) AS near FROM d"""
)
def minimum_distance(spark, sf):
    """Distance to the nearest other reference object, 0 for unselected ones."""
    ev = nested(spark, sf, "pt", "eta", "phi", "charge").withColumn("obj", F.transform("obj", lambda o, i: o.withField("i", i)))
    near = F.transform(
        "obj",
        lambda j: F.get(
            V.min_distance(F.array(j), F.filter("obj", lambda m: (m["charge"] > 0) & (m["i"] != j["i"])), lambda o: o["pt"] > 20), F.lit(0)
        ),
    )
    out = ev.select("k", F.posexplode_outer(near).alias("i", "near"))
    return out.select("k", "i", r("near").alias("near"))


@query(
    f"""WITH {SQL_OBJ}, c AS (SELECT j.k, j.i, t.i AS ti, {sql_dr('j', 't')} AS d FROM obj j JOIN obj t ON j.k = t.k AND t.charge < 0 AND j.charge > 0),
b AS (SELECT k, i, arg_min(ti, (d, ti)) AS ti FROM c WHERE d < 0.8 GROUP BY k, i)
SELECT o.k, o.i, coalesce(b.ti, -1) AS nearest FROM obj o LEFT JOIN b ON o.k = b.k AND o.i = b.i WHERE o.charge > 0"""
)
def nearest_match(spark, sf):
    """Nearest eligible object below a distance, else -1."""
    ev = nested(spark, sf, "eta", "phi", "charge")
    obj = F.transform("obj", lambda o, i: o.withField("i", i))
    ev = ev.withColumn("obj", obj).withColumn("pos", F.filter("obj", lambda o: o["charge"] > 0))
    best = V.nearest(F.col("pos"), F.col("obj"), 0.8, lambda t: t["charge"] < 0)
    out = ev.filter(F.size("pos") > 0).select("k", F.explode_outer(F.arrays_zip(F.col("pos.i").alias("i"), best.alias("nearest"))).alias("x"))
    return out.select("k", F.col("x.i").alias("i"), F.col("x.nearest").alias("nearest"))


@query(
    SQL_P4
    + f""", q AS (SELECT a.k, max(CASE WHEN a.charge * b.charge < 0 AND abs({sql_mass('a', 'b')} - 91.2) < 10 THEN 1 ELSE 0 END) AS hit
  FROM p a JOIN p b ON a.k = b.k AND a.i < b.i WHERE a.pt > 10 AND b.pt > 10 GROUP BY a.k)
SELECT DISTINCT o.k, coalesce(hit, 0) = 1 AS on_peak FROM obj o LEFT JOIN q ON o.k = q.k"""
)
def opposite_pair(spark, sf):
    """Is there an opposite-charge pair near the peak?"""
    ev = nested(spark, sf, "pt", "eta", "phi", "mass", "charge").withColumn("p", V.with_p4(F.filter("obj", lambda o: o["pt"] > 10)))
    return ev.select("k", V.opposite_pair_near(F.col("p")).alias("on_peak"))


@query(
    """SELECT l_orderkey AS k, l_partkey AS code, l_extendedprice AS price,
  CASE WHEN l_partkey BETWEEN 500 AND 599 OR l_partkey BETWEEN 5000 AND 5999 OR l_partkey BETWEEN 50000 AND 59999 THEN 5
       WHEN l_partkey BETWEEN 400 AND 499 OR l_partkey BETWEEN 4000 AND 4999 OR l_partkey BETWEEN 40000 AND 49999 THEN 4 ELSE 0 END AS family,
  l_partkey >= 500 AND ((l_partkey // 100) % 10 = 5 OR (l_partkey // 1000) % 10 = 5) AS b_hadron
FROM lineitem"""
)
def code_families(spark, sf):
    """Category of a code by ranges and by digits."""
    from eventloom.plans.tables import table

    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_partkey").alias("code"),
        F.col("l_extendedprice").alias("price"),
        V.heavy_flavour(F.col("l_partkey")).alias("family"),
        V.is_b_hadron(F.col("l_partkey")).alias("b_hadron"),
    )


FAMILY = "CASE WHEN {c} BETWEEN 500 AND 599 THEN 5 WHEN {c} BETWEEN 400 AND 499 THEN 4 ELSE 0 END"
CODE = "CAST((part * 7 + supp) % 900 AS INTEGER)"


@query(
    f"""WITH {SQL_OBJ}, a AS (SELECT *, {CODE} AS code FROM obj),
w AS (SELECT o.k, o.i, max({FAMILY.format(c='u.code')}) AS best FROM a o JOIN a u ON o.k = u.k AND u.i <= o.i AND (o.i - u.i) % 2 = 0 GROUP BY o.k, o.i)
SELECT a.k, a.i, CASE WHEN best >= 4 THEN best ELSE 3 END AS origin,
  CASE WHEN (supp >> 5) & 1 = 1 OR (supp >> 3) & 1 = 1 THEN 15 WHEN supp & 1 = 1 THEN 1 WHEN best >= 4 THEN best ELSE 3 END AS origin_status
FROM a JOIN w ON a.k = w.k AND a.i = w.i"""
)
def ancestry(spark, sf):
    """Flavour of the ancestry (parent = two positions up), without and with status words."""
    ev = nested(spark, sf, "part", "supp")
    ev = ev.select(
        "k",
        F.transform("obj", lambda o: ((o["part"] * 7 + o["supp"]) % 900).cast("int")).alias("codes"),
        F.transform("obj", lambda o, i: i - 2).alias("parents"),
        F.transform("obj", lambda o: o["supp"]).alias("status"),
    )
    at = F.sequence(F.lit(0), F.size("codes") - 1)
    both = F.transform(
        at,
        lambda i: F.struct(
            V.ancestry_flavour(i, F.col("codes"), F.col("parents")).alias("origin"),
            V.ancestry_flavour(i, F.col("codes"), F.col("parents"), F.col("status")).alias("origin_status"),
        ),
    )
    return ev.select("k", F.posexplode_outer(both).alias("i", "x")).select("k", "i", "x.origin", "x.origin_status")


TRACE = "CAST(CASE WHEN supp % 4 = 0 THEN 6 WHEN supp % 4 = 1 THEN 25 ELSE 500 + part % 100 END AS INTEGER)"


@query(
    f"""WITH {SQL_OBJ}, a AS (SELECT *, {TRACE} AS code FROM obj),
t AS (SELECT a.k, a.i, a.code, a.code >= 500 AND NOT coalesce(c.code >= 500, FALSE) AS terminal
  FROM a LEFT JOIN a c ON a.k = c.k AND c.i = a.i + 1),
o AS (SELECT t.k, t.i, arg_max(u.code, u.i) AS src FROM t JOIN a u ON t.k = u.k AND u.i < t.i AND u.code IN (6, 25) WHERE terminal GROUP BY t.k, t.i)
SELECT t.k, t.i, CASE WHEN terminal THEN coalesce(src, 1) ELSE 0 END AS source FROM t LEFT JOIN o ON t.k = o.k AND t.i = o.i"""
)
def terminal_origin(spark, sf):
    """Origin of terminal hadrons (parent = previous position)."""
    ev = nested(spark, sf, "part", "supp")
    code = lambda o: F.when(o["supp"] % 4 == 0, 6).when(o["supp"] % 4 == 1, 25).otherwise(500 + o["part"] % 100).cast("int")
    ev = ev.select("k", F.transform("obj", code).alias("codes"), F.transform("obj", lambda o, i: i - 1).alias("parents"))
    src = V.terminal_sources(F.col("codes"), F.col("parents"))
    return ev.select("k", F.posexplode_outer(src).alias("i", "source"))


@query(
    f"""WITH {SQL_OBJ} SELECT k, i, round(sqrt(rel * rel + score * score / 100 + 0.0004), 9) AS total,
  round(pt + sqrt(pt * rel * pt * rel + power(greatest(0.0::DOUBLE, greatest(pt * 0.99 * (1 + score / 10), pt * 0.99 * (1 - score / 10)) - pt), 2)), 9) AS top,
  round(least(greatest(pt, 20.1), 59.9), 9) AS safe FROM obj"""
)
def quadrature_and_envelope(spark, sf):
    """Sum of sources in quadrature, upward envelope, clamped values."""
    ev = nested(spark, sf, "pt", "rel", "score")
    total = V.quadrature(
        F.transform("obj", lambda o: o["rel"]), F.transform("obj", lambda o: o["score"] / 10.0), F.transform("obj", lambda o: F.lit(0.02))
    )
    top = F.transform(
        "obj", lambda o: V.up_envelope(o["pt"], o["rel"], o["pt"] * 0.99, 1.0 + o["score"] / 10.0, 1.0 - o["score"] / 10.0)
    )
    safe = F.transform("obj", lambda o: V.clamp(o["pt"], 20.1, 59.9))
    out = ev.select("k", F.posexplode_outer(V.zip_records(total=total, top=top, safe=safe)).alias("i", "x"))
    return out.select("k", "i", r("x.total", 9).alias("total"), r("x.top", 9).alias("top"), r("x.safe", 9).alias("safe"))


@query(
    f"""WITH {SQL_OBJ} SELECT k, round(product(CASE WHEN pt > 20 THEN 1 + rel * 0.7071067 ELSE 1.0::DOUBLE END), 6) AS weight,
  round(sum(pt) / sum(sqrt(pt * cosh(eta) * pt * cosh(eta) + mass * mass)), 6) AS centrality,
  CAST(count(*) FILTER (flag <> 'N' AND score > 0.3) AS INTEGER) AS n_extra FROM obj GROUP BY k"""
)
def products_and_sums(spark, sf):
    """Product over selected objects, centrality, conditional counts."""
    ev = nested(spark, sf, "pt", "eta", "mass", "rel", "flag", "score")
    obj = F.col("obj")
    return ev.select(
        "k",
        r(V.product(obj, lambda o: 1.0 + o["rel"] * 0.7071067, lambda o: o["pt"] > 20)).alias("weight"),
        r(V.centrality(obj)).alias("centrality"),
        V.count_where(obj, lambda o: (o["flag"] != "N") & (o["score"] > 0.3)).alias("n_extra"),
    )


@query(
    SQL_P4
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) - 1 AS q, count(*) OVER (PARTITION BY k) AS c FROM p)
SELECT a.k, CAST(a.q AS INTEGER) AS a, CAST(b.q AS INTEGER) AS b, round({sql_dr('a', 'b')}, 6) AS dr, round({sql_mass('a', 'b')} / 125, 5) AS mass
FROM t a JOIN t b ON a.k = b.k AND a.q < b.q AND b.q < 4 WHERE a.c >= 4"""
)
def top_four_pairs(spark, sf):
    """Four best-scored objects (at least four needed) and their six pairs."""
    ev = nested(spark, sf, "pt", "eta", "phi", "mass", "score").filter(F.size("obj") >= 4)
    ev = ev.withColumn("top", V.with_p4(V.top_by(F.col("obj"), "score", 4)))
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("a"),
                F.lit(j).alias("b"),
                K.delta_r(x["eta"], x["phi"], y["eta"], y["phi"]).alias("dr"),
                K.pair_mass(x["p4"], y["p4"], 125.0).alias("mass"),
            )
            for i, j, x, y in V.pairs_of(F.col("top"), 4)
        ]
    )
    return ev.select("k", F.inline(pairs)).select("k", "a", "b", r("dr").alias("dr"), r("mass", 5).alias("mass"))


@query(
    SQL_P4
    + """, s AS (SELECT k, max(CASE WHEN i = 0 THEN px END) AS px, max(CASE WHEN i = 0 THEN py END) AS py, max(CASE WHEN i = 0 THEN pz END) AS pz, max(CASE WHEN i = 0 THEN eta END) AS eta FROM p GROUP BY k)
SELECT k, round(asinh(pz / sqrt(px * px + py * py)), 6) AS eta_again, round(eta, 6) AS eta, round(px, 6) AS px FROM s"""
)
def four_vector_round_trip(spark, sf):
    """Momentum components and the rapidity recovered from them."""
    ev = nested(spark, sf, "pt", "eta", "phi", "mass").withColumn("p", F.get(V.with_p4(F.col("obj")), F.lit(0)))
    p = F.col("p")
    eta = K.eta_of(p["p4"]["px"], p["p4"]["py"], p["p4"]["pz"])
    return ev.select("k", r(eta).alias("eta_again"), r(p["eta"]).alias("eta"), r(p["p4"]["px"]).alias("px"))


@query(
    f"""WITH {SQL_OBJ}, x AS (SELECT a.k, a.i, b.i AS l1, c.i AS l2, c.supp FROM obj a LEFT JOIN obj b ON a.k = b.k AND b.i = a.i - 1 AND a.i % 3 <> 0
  LEFT JOIN obj c ON b.k = c.k AND c.i = b.i + 1)
SELECT k, i, CAST(CASE WHEN i % 3 = 0 THEN -2 ELSE supp % 7 END AS INTEGER) AS source FROM x"""
)
def followed_links(spark, sf):
    """Chained links with sentinels passed through."""
    ev = nested(spark, sf, "supp").select(
        "k",
        F.transform("obj", lambda o, i: F.when(i % 3 == 0, -2).otherwise(i - 1).cast("int")).alias("link"),
        F.transform("obj", lambda o, i: (i + 1).cast("int")).alias("up"),
        F.transform("obj", lambda o: (o["supp"] % 7).cast("int")).alias("source"),
    )
    src = F.transform("link", lambda i: V.follow(i, F.col("up"), F.col("source")))
    return ev.select("k", F.posexplode_outer(src).alias("i", "source"))
