"""Catalogs, ledgers and input screening."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eventloom.operators.scale import values_table
from eventloom.plans.registry import query
from eventloom.plans.tables import SQL_EV, heads, r, sql_bin, table
from eventloom.sources import catalog as C
from eventloom.sources import ledger as L

TABLES = {"orders_like": ["orders.parquet", "gone.parquet"], "lines": ["lineitem.parquet"], "people": ["customer.parquet", "supplier.parquet"]}

#: orders seen as files: the path of an event row
PATH = "concat('/data/', o_orderpriority, '/f', o_custkey % 20, '.parquet')"
SQL_PATH = "'/data/' || o_orderpriority || '/f' || CAST(o_custkey % 20 AS VARCHAR) || '.parquet'"


def by_file(spark, sf):
    """Event rows with the path of their file."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("channel"), F.expr(PATH).alias("path"), (F.col("o_totalprice") / 100000.0).alias("w"), F.col("o_orderstatus").alias("status"))


def file_catalog(spark, sf):
    """Catalog rows of these files: one per (channel, path)."""
    return by_file(spark, sf).select("channel", "path").distinct()


SQL_FILES = f"WITH e AS (SELECT o_orderkey AS k, o_orderpriority AS channel, {SQL_PATH} AS path, o_totalprice / 100000 AS w, o_orderstatus AS status FROM orders), c AS (SELECT DISTINCT channel, path FROM e)"


@query("SELECT 'lines' AS channel, 'lineitem.parquet' AS name, TRUE AS complete, count(*) AS n FROM lineitem UNION ALL SELECT 'orders_like', 'orders.parquet', FALSE, count(*) FROM orders UNION ALL SELECT 'people', 'customer.parquet', TRUE, count(*) FROM customer UNION ALL SELECT 'people', 'supplier.parquet', TRUE, count(*) FROM supplier")
def catalog_scan(spark, sf):
    """Catalog from JSON, missing paths dropped, all files scanned as one table."""
    doc = json.dumps({"dir": {c: sf for c in TABLES}, "file": TABLES})
    # any store that Spark reads is listed by Spark; a table is a file or a folder
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf)
    name = F.regexp_extract("path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1)
    there = listed.select(F.concat(F.lit(f"{sf}/"), name).alias("path")).distinct()
    cat = C.read_catalog(spark, doc, there)
    rows = C.read_channels(spark, cat)
    counts = rows.groupBy("channel", "source_file").agg(F.count(F.lit(1)).alias("n"))
    out = cat.join(counts, (cat["path"] == counts["source_file"]) & (cat["channel"] == counts["channel"]))
    return out.select(cat["channel"], "name", "complete", "n")


@query(f"{SQL_FILES} SELECT channel, path FROM c WHERE channel IN ('1-URGENT', '5-LOW')")
def channel_files(spark, sf):
    """Files of some channels, unknown names skipped."""
    return C.channel_files(file_catalog(spark, sf), ["1-URGENT", "5-LOW", "unknown"])


@query(f"{SQL_FILES}, m AS (SELECT channel, path, row_number() OVER (PARTITION BY channel ORDER BY path) AS rn FROM c) SELECT channel, path, CAST((rn - 1) // 3 AS INTEGER) AS chunk FROM m WHERE rn <= 8 AND (channel LIKE '%H%' OR channel = '5-LOW')")
def wildcard_channels(spark, sf):
    """Channels by wildcard, a cap on files per channel, chunks of inputs."""
    cat = file_catalog(spark, sf)
    names = C.match_channels(cat, ["*HIGH", "5-*"])
    assert C.switch_channels(names, on=["HIGH|LOW"]) == names
    capped = C.cap_files(C.channel_files(cat, [*names]), 8)
    return C.chunked(capped, 3)


SQL_FILES_H = SQL_FILES


@query(
    f"""{SQL_FILES}, n AS (SELECT path, count(*) FILTER (status = 'F') AS n_rows FROM e GROUP BY path), l AS (SELECT path, sum(w) AS s FROM e WHERE path NOT LIKE '%f7.parquet' GROUP BY path)
SELECT c.channel, c.path, CASE WHEN s IS NULL THEN 'no_ledger' WHEN coalesce(n_rows, 0) = 0 THEN 'no_events' ELSE 'ok' END AS state FROM c LEFT JOIN n USING (path) LEFT JOIN l USING (path)"""
)
def screened_files(spark, sf):
    """Usable files: with rows after selection and with a ledger entry."""
    ev = by_file(spark, sf)
    counts = ev.filter("status = 'F'").groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    totals = L.ledger(ev.filter("path NOT LIKE '%f7.parquet'"), ["path"], "w").select("path", "sum_w")
    return L.screen(file_catalog(spark, sf), counts, totals).select("channel", "path", "state")


@query(
    f"""{SQL_FILES} SELECT path, count(*) AS n_rows, round(sum(w), 9) AS sum_w, CAST(count(*) AS DOUBLE) AS sum_data FROM e GROUP BY path"""
)
def weight_ledger(spark, sf):
    """Rows and sum of weights per file before cuts; sum of ones for data."""
    out = L.ledger(by_file(spark, sf), ["path"], "w")
    return out.withColumns({"sum_data": F.col("n_rows").cast("double"), "sum_w": r("sum_w", 9)})


@query(
    f"""{SQL_FILES} SELECT path, CASE WHEN path LIKE '%f1%' THEN 'ledger' WHEN path LIKE '%f2%' THEN 'runs' ELSE 'events' END AS origin, round(CASE WHEN path LIKE '%f1%' THEN sum(w) WHEN path LIKE '%f2%' THEN sum(w) * 2 ELSE count(*) END, 9) AS sum_w FROM e GROUP BY path"""
)
def ledger_fallback(spark, sf):
    """Ledger, else run table, else sum over events."""
    ev = by_file(spark, sf)
    sums = L.ledger(ev, ["path"], "w")
    ledger_sums = sums.filter("path LIKE '%f1%'")
    runs = sums.filter("path LIKE '%f2%'").withColumn("sum_w", F.col("sum_w") * 2)
    plain = L.ledger(ev, ["path"])
    out = L.total_weights(ev.select("path").distinct(), ledger_sums, runs, plain)
    return out.select("path", "origin", r("sum_w", 9).alias("sum_w"))


@query(
    f"""{SQL_FILES}, l AS (SELECT path, sum(w) AS s FROM e GROUP BY path), k AS (SELECT path, sum(w) AS kept FROM e WHERE w > 4.5 GROUP BY path)
SELECT channel, count(*) AS n_files, round(sum(s), 9) AS sum_w, round(coalesce(sum(kept), 0), 9) AS kept FROM c LEFT JOIN l USING (path) LEFT JOIN k USING (path) GROUP BY channel"""
)
def totals_with_empty_files(spark, sf):
    """Channel totals count files whose selected table is empty."""
    ev = by_file(spark, sf)
    out = L.channel_totals(file_catalog(spark, sf), L.ledger(ev, ["path"], "w").select("path", "sum_w"))
    kept = ev.groupBy("channel").agg(F.coalesce(F.sum(F.when(F.col("w") > 4.5, F.col("w"))), F.lit(0.0)).alias("kept"))
    return out.join(kept, "channel").select("channel", "n_files", r("sum_w", 9).alias("sum_w"), r("kept", 9).alias("kept"))


@query(f"""{SQL_FILES} SELECT channel, path, channel || '-' || regexp_extract(path, '([^/]+)$', 1) AS output FROM c WHERE path NOT LIKE '%f3.parquet'""")
def pending_inputs(spark, sf):
    """Inputs without a valid output, with the name of their output."""
    cat = file_catalog(spark, sf)
    manifest = cat.filter("path LIKE '%f3.parquet' OR path LIKE '%f4.parquet'").select("path", F.col("path").like("%f3.parquet").alias("valid"))
    out = C.pending(cat, manifest)
    return out.select("channel", "path", C.output_name(F.col("path")).alias("output"))


@query(
    """WITH p AS (SELECT o_orderstatus || '_' || o_orderpriority || '/x/f' || CAST(o_orderkey AS VARCHAR) AS path FROM orders),
c AS (SELECT path, regexp_extract(path, '^([^/]+)', 1) AS folder FROM p)
SELECT path, folder, CASE WHEN folder = 'F_1-URGENT' THEN 'urgentF' WHEN regexp_matches(path, '^O_.*(HIGH|LOW)') THEN 'openRanked' WHEN regexp_matches(path, '[05]$') THEN 'round' END AS channel FROM c"""
)
def named_channels(spark, sf):
    """Channel of a path by dictionary, else by pattern rules."""
    p = table(spark, sf, "orders").select(F.expr("concat(o_orderstatus, '_', o_orderpriority, '/x/f', o_orderkey)").alias("path"))
    return C.name_channels(p, "path", {"F_1-URGENT": "urgentF"}, [("^O_.*(HIGH|LOW)", "openRanked"), ("[05]$", "round")])


@query(
    """WITH p AS (SELECT o_orderstatus || '_' || o_orderpriority AS folder FROM orders) SELECT folder, count(*) AS n_paths FROM p WHERE folder <> 'F_1-URGENT' AND NOT regexp_matches(folder, '^O_.*(HIGH|LOW)') GROUP BY folder"""
)
def unknown_folders(spark, sf):
    """Folders no rule covers, reported with their path counts."""
    p = table(spark, sf, "orders").select(F.expr("concat(o_orderstatus, '_', o_orderpriority, '/x/f', o_orderkey)").alias("path"))
    return C.unknown_folders(C.name_channels(p, "path", {"F_1-URGENT": "urgentF"}, [("^O_.*(HIGH|LOW)", "openRanked")]))


@query(
    f"""{SQL_FILES}, l AS (SELECT path, sum(w) AS s FROM e GROUP BY path) SELECT channel, CAST(dense_rank() OVER (ORDER BY channel) - 1 AS INTEGER) AS channel_id, count(*) AS n_events, round(sum(w), 9) AS weight_sum, round(sum(abs(w - 1)), 8) AS abs_weight_sum, count(*) FILTER (status = 'F') AS same_sign FROM e GROUP BY channel"""
)
def concatenated_report(spark, sf):
    """Per-channel inputs concatenated with a channel id and reported."""
    names = sorted(C.match_channels(file_catalog(spark, sf), ["*"]))
    ev = by_file(spark, sf)
    ids = values_table(spark, "channel string, channel_id int", [(n, i) for i, n in enumerate(names)])
    tagged = ev.join(ids, "channel")
    return tagged.groupBy("channel", "channel_id").agg(
        F.count(F.lit(1)).alias("n_events"), r(F.sum("w"), 9).alias("weight_sum"), r(F.sum(F.abs(F.col("w") - 1)), 8).alias("abs_weight_sum"), F.count_if(F.col("status") == "F").alias("same_sign")
    )


@query(f"""{SQL_FILES}, l AS (SELECT path, sum(w) AS s FROM e GROUP BY path) SELECT '/new' || path AS path, round(s, 9) AS sum_w FROM l""")
def carried_ledger(spark, sf):
    """Ledger rows under the path of the new output."""
    out = L.carry_over(L.ledger(by_file(spark, sf), ["path"], "w"), F.concat(F.lit("/new"), F.col("path")))
    return out.select("path", r("sum_w", 9).alias("sum_w"))


@query(f"""WITH {SQL_EV} SELECT 'w' AS var, 'MCTotalWeight' AS weight, count(*) > 0 AS found FROM ev UNION ALL SELECT 'w', 'MCTotalWeight_up', count(*) > 0 FROM ev""")
def stored_variants(spark, sf):
    """Histograms stored, loaded and listed by their variants."""
    from eventloom.functions.binning import Axis
    from eventloom.operators import histogram as H
    from eventloom.session import shared_dir
    from eventloom.sources import histstore as K
    import uuid

    ev = heads(spark, sf, "channel", "era", "w")
    ax = Axis("w", 10, 0.0, 5.0)
    hist = H.fill_weights(ev, [ax], {"MCTotalWeight": F.col("w"), "MCTotalWeight_up": F.col("w") * 1.1}, ["era", "channel"])
    path = f"{shared_dir(spark)}/hists-{uuid.uuid4().hex}"
    K.save(H.with_edges(hist.withColumn("var", F.lit("w")), ax), path)
    back = K.load(spark, path, factor=2.0, fold=ax.n)
    return K.variants(back).withColumn("found", F.lit(True))


@query(
    f"""WITH {SQL_EV}, b AS (SELECT era, channel, greatest(1, least(10, {sql_bin('w', 10, 0.0, 2.0)})) AS ix, w FROM ev),
v AS (SELECT era, channel, ix, 'MCTotalWeight' AS weight, sqrt(w) AS w FROM b UNION ALL SELECT era, channel, ix, 'MCTotalWeight_up', sqrt(w) * 1.1::DOUBLE FROM b)
SELECT era, channel, 'w' AS var, weight, CAST(ix AS INTEGER) AS ix, round(sum(w) / 7, 6) AS sumw, round(sum(w * w) / 49, 5) AS sumw2, count(*) AS n FROM v GROUP BY era, channel, weight, ix"""
)
def stored_contents(spark, sf):
    """Contents of stored histograms, loaded with a factor and folded flow bins."""
    import uuid

    from eventloom.functions.binning import Axis
    from eventloom.operators import histogram as H
    from eventloom.session import shared_dir
    from eventloom.sources import histstore as K

    ax = Axis("w", 10, 0.0, 2.0)
    hist = H.fill_weights(heads(spark, sf, "channel", "era", "w"), [ax], {"MCTotalWeight": F.sqrt("w"), "MCTotalWeight_up": F.sqrt("w") * 1.1}, ["era", "channel"])
    path = f"{shared_dir(spark)}/hists-{uuid.uuid4().hex}"
    K.save(H.with_edges(hist.withColumn("var", F.lit("w")), ax), path)
    back = K.load(spark, path, factor=1 / 7, fold=ax.n)
    return back.select("era", "channel", "var", "weight", "ix", r("sumw").alias("sumw"), r("sumw2", 5).alias("sumw2"), "n")


SQL_SKIMMED = """WITH e AS (SELECT o_orderstatus AS status, o_orderpriority AS channel, o_totalprice / 100000 AS w FROM orders),
g AS (SELECT status, count(*) AS n_rows, sum(w) AS sum_w, count(*) FILTER (w > 1.5 AND channel <> '5-LOW') AS n_kept, sum(w) FILTER (w > 1.5 AND channel <> '5-LOW') AS kept_w FROM e GROUP BY status)"""


@query(
    SQL_SKIMMED
    + """ SELECT 'status=' || status AS input, 'ok' AS state, n_rows, round(sum_w, 6) AS sum_w, n_kept, round(kept_w, 6) AS kept_w, FALSE AS due FROM g
UNION ALL SELECT 'none', 'no_rows', NULL, NULL, NULL, NULL, TRUE FROM g WHERE status = 'F' UNION ALL SELECT 'broken', 'no_rows', NULL, NULL, NULL, NULL, TRUE FROM g WHERE status = 'F'"""
)
def tolerant_skim(spark, sf):
    """Skim of a folder with an empty file and one that is no table: rows, ledger and
    states in one pass over the events, outputs named by a manifest."""
    import uuid

    from eventloom.session import shared_dir
    from eventloom.sources import skimrun as K

    base = f"{shared_dir(spark)}/skims/{uuid.uuid4().hex}"
    ev = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("channel"), F.expr("o_totalprice / 100000D").alias("w"), F.col("o_orderstatus").alias("status"))
    ev.repartition("status").write.partitionBy("status").parquet(f"{base}/in")
    ev.where("false").drop("status").coalesce(1).write.parquet(f"{base}/in/none")
    ev.limit(1).select(F.lit("no table at all").alias("value")).write.text(f"{base}/in/broken")
    listing = K.listed(spark, f"{base}/in", "part-*")
    events = K.tolerant_events(spark, f"{base}/in", ev.drop("status").schema, "part-*")
    K.run_skim(events, listing, f"{base}/out", (F.col("w") > 1.5) & (F.col("channel") != "5-LOW"), ["k", "w"], F.col("w"))
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    states = K.manifest(spark, f"{base}/out").groupBy(folder.alias("input"), "state").agg(F.sum("n_rows").alias("n_rows"), F.sum("sum_w").alias("sum_w"), F.sum("n_kept").alias("n_kept"))
    kept = K.kept_rows(spark, f"{base}/out").groupBy(F.regexp_extract("source", "([^/]+)/[^/]+$", 1).alias("input")).agg(F.sum("w").alias("kept_w"))
    again = K.due(listing, f"{base}/out").select(folder.alias("input"), F.lit(True).alias("due")).distinct()
    out = states.join(kept, "input", "left").join(again, "input", "left")
    return out.select("input", "state", "n_rows", r("sum_w").alias("sum_w"), "n_kept", r("kept_w").alias("kept_w"), F.coalesce("due", F.lit(False)).alias("due"))
