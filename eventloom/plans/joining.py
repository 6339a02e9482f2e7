"""Key, interval, binned, name and dimension joins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eventloom.operators import joins as J
from eventloom.operators import lookup as L
from eventloom.operators.scale import values_table
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, SQL_OBJ, heads, nested, objects, r, table
from eventloom.sources import intervals as I

KEY = ["run", "block", "k"]


@query(
    f"""WITH {SQL_EV} SELECT run, block, k, round(w, 9) AS w FROM ev
WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"""
)
def keep_listed_events(spark, sf):
    """Raw rows whose event key is in the skim, with requested columns."""
    raw = heads(spark, sf, "run", "block", "w", "channel")
    hit = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("k"))
    skim = raw.join(hit, "k", "left_semi")
    return J.keep_listed(raw, skim, KEY, ["w"]).withColumn("w", r("w", 9))


@query(
    """WITH s AS (SELECT l_orderkey, arg_min(l_quantity, (l_linenumber, l_extendedprice)) AS q, arg_min(l_returnflag, (l_linenumber, l_extendedprice)) AS f
  FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey AS k, coalesce(q, -999.0) AS quantity, coalesce(f, '') AS flag FROM orders LEFT JOIN s ON o_orderkey = l_orderkey"""
)
def lookup_first(spark, sf):
    """Left lookup by key with typed defaults, the first duplicate counts."""
    src = table(spark, sf, "lineitem").filter("l_quantity > 25").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_extendedprice", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")
    )
    defaults = {"quantity": F.lit(-999.0), "flag": F.lit("")}
    return J.lookup_by_key(heads(spark, sf), src, ["k"], defaults, F.struct("l_linenumber", "l_extendedprice"))


@query(
    """WITH p AS (SELECT l_orderkey, l_returnflag AS f, arg_max(l_discount, (l_linenumber, l_extendedprice)) AS s,
    CAST(arg_max(l_linenumber, (l_linenumber, l_extendedprice)) AS INTEGER) AS c FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS k, a.s IS NOT NULL AS up_isMatched, coalesce(a.s, -1.0) AS up_score, coalesce(a.c, -1) AS up_label,
  b.s IS NOT NULL AS down_isMatched, coalesce(b.s, -1.0) AS down_score, coalesce(b.c, -1) AS down_label
FROM orders LEFT JOIN p a ON a.l_orderkey = o_orderkey AND a.f = 'R' LEFT JOIN p b ON b.l_orderkey = o_orderkey AND b.f = 'A'"""
)
def attach_predictions(spark, sf):
    """Predictions of several variations attached by key, last duplicate wins."""
    out = heads(spark, sf)
    for prefix, flag in (("up_", "R"), ("down_", "A")):
        src = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select(
            F.col("l_orderkey").alias("k"), "l_linenumber", "l_extendedprice", F.col("l_discount").alias("score"), F.col("l_linenumber").alias("label")
        )
        out = J.lookup_by_key(
            out, src, ["k"], {"score": F.lit(-1.0), "label": F.lit(-1)}, F.struct("l_linenumber", "l_extendedprice"), last=True, matched="isMatched", prefix=prefix
        )
    return out


RANGES = {"1995": [[1, 40], [100, 180]], "1997": [[30, 90]], "1998": [[1, 366]], "2000": [[200, 210], [205, 300]], "comment": [[1, 2]]}
SQL_RANGES = "(VALUES " + ", ".join(f"({y}, {a}, {b})" for y, rs in RANGES.items() if y.isdigit() for a, b in rs) + ") g(gy, lo, hi)"


@query(
    f"""WITH {SQL_EV} SELECT k, run, block FROM ev WHERE EXISTS (SELECT 1 FROM {SQL_RANGES} WHERE gy = run AND block BETWEEN lo AND hi)"""
)
def run_range_filter(spark, sf):
    """Events inside the listed ranges of their run (list read from JSON)."""
    doc = values_table(spark, "doc string", [(json.dumps(RANGES),)])
    return L.in_ranges(heads(spark, sf, "run", "block"), "run", "block", I.run_ranges(doc, "doc"))


def _scale_doc(p: float) -> dict:
    row = lambda a, b, h, l: {"lumisec_start": a, "lumisec_end": b, "hltprescale": h, "l1prescale": l}
    return {
        "1995": [row(1, 50, 2 * p, 1), row(51, 200, 4 * p, 2)],
        "1996": [row(10, 20, p, 1), row(40, 30, p, 1)],
        "1999": [row(1, 366, 3 * p, 1)],
        "notes": [row(1, 2, p, p)],
    }


def _sql_scale(p: float) -> str:
    rows = [(1995, 1, 50, 2 * p), (1995, 51, 200, 8 * p), (1996, 10, 20, p), (1999, 1, 366, 3 * p)]
    return "(VALUES " + ", ".join(f"({a}, {b}, {c}, {d}::DOUBLE)" for a, b, c, d in rows) + ") t(y, lo, hi, v)"


@query(
    f"""WITH {SQL_EV} SELECT k, coalesce((SELECT max(v) FROM {_sql_scale(1.0)} WHERE y = run AND block BETWEEN lo AND hi), 0.0::DOUBLE) AS prescale_a,
  coalesce((SELECT max(v) FROM {_sql_scale(2.5)} WHERE y = run AND block BETWEEN lo AND hi), 0.0::DOUBLE) AS prescale_b FROM ev"""
)
def prescale_lookup(spark, sf):
    """Prescale of the range that contains the block, else 0, for two paths."""
    from eventloom.operators.corrections import Context, apply_corrections

    frames = {}
    for name, p in (("a", 1.0), ("b", 2.5)):
        doc = values_table(spark, "doc string", [(json.dumps(_scale_doc(p)),)])
        frames[f"prescale_{name}"] = I.prescale_rows(doc, "doc")
    ctx = Context(frames=frames, options={"prescale": {"paths": ("a", "b")}})
    return apply_corrections(heads(spark, sf, "run", "block"), ["prescale"], ctx).select("k", "prescale_a", "prescale_b")


SQL_MANY_RANGES = """rg AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END AS run, (o_orderkey * 7 + j) * 10 AS lo, (o_orderkey * 7 + j) * 10 + (o_orderkey * (j + 3)) % 10 AS hi,
    ((o_orderkey + j) % 17) * 0.5::DOUBLE AS value FROM orders, (SELECT range AS j FROM range(7))),
ln AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_partkey % 10 = 0 THEN 2 ELSE 1 END AS run, (l_orderkey * 7 + l_suppkey % 8) * 10 + l_partkey % 10 AS block FROM lineitem)"""


def _many_ranges(spark, sf):
    """Seven ranges for every order, nearly all of them in one run."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    lo = (F.col("o") * 7 + F.col("j")) * 10
    return o.select(F.when(F.col("o") % 50 == 0, 2).otherwise(1).alias("run"), lo.alias("lo"), (lo + (F.col("o") * (F.col("j") + 3)) % 10).alias("hi"), ((F.col("o") + F.col("j")) % 17 * F.lit(0.5)).alias("value"))


def _numbered_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    block = (F.col("l_orderkey") * 7 + F.col("l_suppkey") % 8) * 10 + F.col("l_partkey") % 10
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 10 == 0, 2).otherwise(1).alias("run"), block.alias("block"))


@query(f"WITH {SQL_MANY_RANGES} SELECT k, line, coalesce(CASE WHEN block <= hi THEN value END, -1.0::DOUBLE) AS scale FROM ln ASOF LEFT JOIN rg ON ln.run = rg.run AND ln.block >= rg.lo")
def prescale_of_long_lists(spark, sf):
    """Values of ranges where one run has very many of them."""
    out = L.interval_value(_numbered_lines(spark, sf), "run", "block", {"scale": _many_ranges(spark, sf)}, default=-1.0)
    return out.select("k", "line", "scale")


@query(f"WITH {SQL_MANY_RANGES} SELECT k, line, block FROM ln WHERE EXISTS (SELECT 1 FROM rg WHERE rg.run = ln.run AND rg.lo = ln.block - ln.block % 10 AND ln.block <= rg.hi)")
def run_ranges_of_long_lists(spark, sf):
    """Rows inside any of the very many ranges of a run."""
    return L.in_ranges(_numbered_lines(spark, sf), "run", "block", _many_ranges(spark, sf)).select("k", "line", "block")


PT_EDGES = (0.0, 10.0, 20.0, 40.0, 60.0, 100.0)
ETA_EDGES = (-2.4, -1.5, 0.0, 1.5, 2.4)
FLAGS = ("A", "N", "R")


def flag_table(flow: str = "clamp") -> L.BinnedTable:
    values = [0.8 + 0.01 * n for n in range(len(FLAGS) * 5 * 4)]
    return L.BinnedTable([("pt", PT_EDGES), ("eta", ETA_EDGES)], values, [("flag", FLAGS)], flow)


def sql_flag_table() -> str:
    rows = []
    n = 0
    for f in FLAGS:
        for a, b in zip(PT_EDGES, PT_EDGES[1:]):
            for c, d in zip(ETA_EDGES, ETA_EDGES[1:]):
                rows.append(f"('{f}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {0.8 + 0.01 * n!r}::DOUBLE)")
                n += 1
    return "tab(tf, plo, phi_, elo, ehi, v) AS (VALUES " + ", ".join(rows) + ")"


SQL_TAB_ON = """tf = o.flag AND least(greatest(o.pt, 0.0), 99.999999) >= plo AND least(greatest(o.pt, 0.0), 99.999999) < phi_
  AND least(greatest(o.eta, -2.4::DOUBLE), 2.399999::DOUBLE) >= elo AND least(greatest(o.eta, -2.4::DOUBLE), 2.399999::DOUBLE) < ehi"""


@query(f"""WITH {SQL_OBJ}, {sql_flag_table()} SELECT o.k, o.i, round(v, 9) AS sf FROM obj o LEFT JOIN tab ON {SQL_TAB_ON}""")
def binned_lookup_inline(spark, sf):
    """Table lookup for every object inside the row."""
    t = flag_table()
    ev = nested(spark, sf, "pt", "eta", "flag")
    out = ev.select("k", F.posexplode_outer(F.transform("obj", lambda o: t.at(o["flag"], o["pt"], o["eta"]))).alias("i", "sf"))
    return out.withColumn("sf", r("sf", 9))


@query(
    f"""WITH {SQL_OBJ}, {sql_flag_table()} SELECT flag, round(sum(v), 6) AS sf, count(*) AS n FROM obj o LEFT JOIN tab ON {SQL_TAB_ON} GROUP BY flag"""
)
def binned_lookup_join(spark, sf):
    """The same lookup as an equi join on bin numbers, for tables of any size."""
    o = objects(spark, sf, "pt", "eta", "flag")
    out = L.join_lookup(o, flag_table(), {"flag": F.col("flag"), "pt": F.col("pt"), "eta": F.col("eta")}, "sf")
    return out.groupBy("flag").agg(r(F.sum("sf")).alias("sf"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_OBJ}, {sql_flag_table()} SELECT o.k, round(product(v), 6) AS weight FROM obj o LEFT JOIN tab ON {SQL_TAB_ON} GROUP BY o.k""")
def binned_lookup_array(spark, sf):
    """Explode, join and collect by position, then a product per event."""
    from eventloom.functions import vectors as V

    ev = nested(spark, sf, "pt", "eta", "flag")
    out = L.join_lookup_array(ev, ["k"], "obj", flag_table(), {"flag": "flag", "pt": "pt", "eta": "eta"}, "sf")
    return out.select("k", r(V.product(F.col("sf"), lambda x: x)).alias("weight"))


@query(
    """WITH raw AS (SELECT '/raw/' || CAST(o_custkey % 5 AS VARCHAR) || '/f' || CAST(o_orderkey // 2 AS VARCHAR) || '.parquet' AS raw_path FROM orders),
b AS (SELECT regexp_extract(raw_path, '([^/]+)$', 1) AS base, min(raw_path) AS raw_path FROM raw GROUP BY 1)
SELECT '/skim/' || o_orderstatus || '/' || CAST(o_orderkey % 7 AS VARCHAR) || '-f' || CAST(o_orderkey AS VARCHAR) || '.parquet' AS skim_path, raw_path
FROM orders LEFT JOIN b ON base = 'f' || CAST(o_orderkey AS VARCHAR) || '.parquet'"""
)
def files_by_base_name(spark, sf):
    """Pair skim and raw files by the base name inside the skim path."""
    o = table(spark, sf, "orders")
    raws = o.select(F.expr("concat('/raw/', o_custkey % 5, '/f', o_orderkey div 2, '.parquet')").alias("raw_path"))
    skims = o.select(F.expr("concat('/skim/', o_orderstatus, '/', o_orderkey % 7, '-f', o_orderkey, '.parquet')").alias("skim_path"))
    return J.match_by_base_name(skims, raws).select("skim_path", "raw_path")


XSEC = [("1-URGENT", 0.5), ("2-HIGH", 1.25), ("3-MEDIUM", 2.0), ("4-NOT SPECIFIED", 3.5)]
EXTRA = [("2-HIGH", 1.1), ("3-MEDIUM", 0.9)]
LUMI = [(1995, 1.5), (1996, 2.0), (1997, 2.5), (1998, 3.0), (1999, 3.5), (2000, 4.0), (2001, 4.5)]


def _sql_values(rows, name):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in x) + ")" for x in rows) + f") {name}"


@query(
    f"""WITH {SQL_EV} SELECT ev.channel, ev.era, count(*) AS n, round(sum(w * coalesce(x.f, 1) * coalesce(e.f, 1) * lumi), 6) AS total
FROM ev LEFT JOIN {_sql_values(XSEC, 'x(channel, f)')} ON ev.channel = x.channel LEFT JOIN {_sql_values(EXTRA, 'e(channel, f)')} ON ev.channel = e.channel
JOIN {_sql_values(LUMI, 'l(era, lumi)')} ON l.era = ev.era GROUP BY ev.channel, ev.era"""
)
def dimension_factors(spark, sf):
    """Cross-section and several scale files by channel, luminosity by era."""
    ev = heads(spark, sf, "channel", "era", "w")
    files = [values_table(spark, "channel string, factor double", rows) for rows in (XSEC, EXTRA)]
    lumi = values_table(spark, "era int, lumi double", LUMI)
    out = J.with_factor(ev, "channel", files, "f").join(lumi, "era")
    return out.groupBy("channel", "era").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("w") * F.col("f") * F.col("lumi"))).alias("total"))


def _region_aliases(spark, sf):
    n, reg = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        n.join(reg, n["n_regionkey"] == reg["r_regionkey"])
        .groupBy(F.col("r_name").alias("alias"))
        .agg(F.sort_array(F.collect_list("n_name")).alias("members"))
    )


@query("SELECT n_name AS source FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT 'LUMI' WHERE (SELECT count(*) FROM nation) > 0")
def alias_expansion(spark, sf):
    """Aliases replaced by the names they stand for; a duplicate would raise."""
    names = table(spark, sf, "region").filter("r_name <> 'ASIA'").select(F.col("r_name").alias("source"))
    names = names.unionByName(values_table(spark, "source string", [("LUMI",)]))
    return J.expand_aliases(names, "source", _region_aliases(spark, sf))


@query(
    """WITH lst AS (SELECT r_regionkey AS pos, r_name AS source FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation),
x AS (SELECT pos, coalesce(n_name, source) AS source FROM lst LEFT JOIN region ON r_name = source LEFT JOIN nation ON n_regionkey = r_regionkey)
SELECT source, CAST(min(pos) AS INTEGER) AS pos FROM x GROUP BY source"""
)
def alias_expansion_first_wins(spark, sf):
    """The lenient form: the first occurrence of a name counts."""
    names = table(spark, sf, "region").selectExpr("r_regionkey AS pos", "r_name AS source").unionByName(
        table(spark, sf, "nation").selectExpr("100 + n_nationkey AS pos", "n_name AS source")
    )
    return J.expand_aliases(names, "source", _region_aliases(spark, sf), strict=False).select("source", "pos")


@query(f"""WITH {SQL_EV} SELECT channel, count(*) AS n FROM ev WHERE channel IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY channel""")
def variation_groups(spark, sf):
    """Named groups of groups, expanded in order without duplicates."""
    groups = {"fast": ["1-URGENT", "2-HIGH"], "most": ["fast", "5-LOW", "2-HIGH"]}
    wanted = J.expand_nested(["fast", "most"], groups)
    ev = heads(spark, sf, "channel")
    return ev.filter(F.col("channel").isin(*wanted)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey AS row_index, round(o_totalprice, 2) AS price, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""
)
def by_row_number(spark, sf):
    """Two tables that carry the same stored row number."""
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index"), F.round("o_totalprice", 2).alias("price"))
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_index")).agg(F.count(F.lit(1)).alias("n"))
    return J.on_row_number(left, right)


LABELS = [("large", "LARGE", "heavy"), ("red", "RED", "colour"), ("ring", "RING", "shape"), ("bolt", "BOLT", "shape")]


@query(
    """SELECT p_partkey, CASE WHEN contains(n, 'LARGE') THEN 'LARGE' WHEN contains(n, 'RED') THEN 'RED' WHEN contains(n, 'RING') THEN 'RING' WHEN contains(n, 'BOLT') THEN 'BOLT' END AS channel,
  CASE WHEN contains(n, 'LARGE') THEN 'heavy' WHEN contains(n, 'RED') THEN 'colour' WHEN contains(n, 'RING') OR contains(n, 'BOLT') THEN 'shape' END AS klass,
  CASE WHEN contains(p_name, 'blue bolt') THEN 'blue bolt' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'blue') THEN 'blue' END AS sample
FROM (SELECT *, upper(p_name || ' ' || p_type) AS n FROM part)"""
)
def sample_labels(spark, sf):
    """Sample name -> channel -> class by the first contained alias; longest key."""
    p = table(spark, sf, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_type"))
    p = J.first_label(p, "name", LABELS)
    return p.select("p_partkey", "channel", "klass", J.longest_contained(F.col("p_name"), ["blue", "bolt", "blue bolt"]).alias("sample"))


@query(
    f"""WITH {SQL_EV} SELECT channel AS variation, round(sum(CASE WHEN status = 'F' THEN w END), 9) AS dd, round(sum(CASE WHEN status <> 'F' THEN w END), 9) AS mc FROM ev GROUP BY channel"""
)
def matched_weight_names(spark, sf):
    """Two weight families joined on the variation inside their names."""
    ev = heads(spark, sf, "channel", "status", "w")
    family = F.when(F.col("status") == "F", "DDTotalWeight_").otherwise("MCTotalWeight_")
    sums = ev.groupBy(F.concat(family, "channel").alias("weight")).agg(F.sum("w").alias("s"))
    sums = sums.withColumn("variation", J.variation_of(F.col("weight"), ["DDTotalWeight", "MCTotalWeight"]))
    is_dd = F.col("weight").startswith("DD")
    return sums.groupBy("variation").agg(r(F.sum(F.when(is_dd, F.col("s"))), 9).alias("dd"), r(F.sum(F.when(~is_dd, F.col("s"))), 9).alias("mc"))


@query(
    f"""WITH {SQL_EV}, e AS (SELECT 'Run' || CAST(era AS VARCHAR) || status AS era, count(*) / 1000.0::DOUBLE AS lumi FROM ev GROUP BY era, status)
SELECT 'Run1997' AS year, round(sum(lumi) FILTER (starts_with(era, 'Run1997')), 9) AS lumi FROM e
UNION ALL SELECT 'Run2030', round(sum(lumi), 9) FROM e"""
)
def luminosity_of_year(spark, sf):
    """Luminosity of a year by key prefix; of everything when the year is unknown."""
    ev = heads(spark, sf, "era", "status")
    eras = ev.groupBy(F.concat(F.lit("Run"), F.col("era").cast("string"), "status").alias("era")).agg((F.count(F.lit(1)) / 1000.0).alias("lumi"))
    one = lambda y: J.total_luminosity(eras, y).select(F.lit(y).alias("year"), r("lumi", 9).alias("lumi"))
    return one("Run1997").unionByName(one("Run2030"))
