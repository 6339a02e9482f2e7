"""Catalog, ledger, stores and incremental skims."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators import corrections as C
from eventloom.operators import histogram as H
from eventloom.operators.steps import StepList
from eventloom.plans.jobs import JobType, SkimJob
from eventloom.plans.tables import heads
from eventloom.sources import catalog as K
from eventloom.sources import histstore as ST
from eventloom.sources import ledger as L
from eventloom.sources.nested import from_parallel_arrays
from eventloom.streaming.incremental import skim_new_files


def test_catalog_needs_both_keys(spark):
    with pytest.raises(ValueError):
        K.read_catalog(spark, json.dumps({"dir": {}}))
    cat = K.read_catalog(spark, json.dumps({"dir": {"a": "/x/"}, "file": {"a": ["1", "2"], "b": ["3"]}}))
    assert sorted(r["path"] for r in cat.collect()) == ["/x/1", "/x/2"]
    with pytest.raises(ValueError):
        K.match_channels(cat, ["z*"])


def test_read_channels_from_folders(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    spark.range(3).write.parquet(str(tmp_path / "b"))
    doc = json.dumps({"dir": {"one": str(tmp_path), "two": str(tmp_path)}, "file": {"one": ["a"], "two": ["b"]}})
    rows = K.read_channels(spark, K.read_catalog(spark, doc))
    assert {r["channel"]: r["count"] for r in rows.groupBy("channel").count().collect()} == {"one": 5, "two": 3}


def test_strict_screen_and_missing_sums_raise(spark):
    cat = spark.createDataFrame([("c", "p")], "channel string, path string")
    none = spark.createDataFrame([], "path string, n_rows long")
    sums = spark.createDataFrame([], "path string, sum_w double")
    assert L.screen(cat, none, sums).first()["state"] == "no_ledger"
    with pytest.raises(Exception, match="no ledger"):
        L.screen(cat, none, sums, strict=True).collect()
    with pytest.raises(Exception, match="no sum of weights"):
        L.total_weights(cat, sums, sums, sums).collect()


def test_observed_total_comes_with_the_rows(spark, sf, tmp_path):
    ev, obs = L.observed(heads(spark, sf, "w"), F.col("w"))
    ev.filter("w > 1").write.parquet(str(tmp_path / "out"))
    total = heads(spark, sf, "w").agg(F.sum("w"), F.count(F.lit(1))).first()
    assert obs.get["sum_w"] == pytest.approx(total[0]) and obs.get["n_rows"] == total[1]


def test_histogram_store_replaces_only_its_partitions(spark, sf, tmp_path):
    path = str(tmp_path / "h")
    ax = Axis("w", 5, 0.0, 5.0)
    hist = H.with_edges(H.fill_weights(heads(spark, sf, "channel", "era", "w"), [ax], {"m": F.col("w")}, ["era", "channel"]).withColumn("var", F.lit("w")), ax)
    ST.save(hist, path)
    n = spark.read.parquet(path).count()
    ST.save(H.scale(hist.filter("era = 1995"), F.lit(2.0)), path)
    back = spark.read.parquet(path)
    assert back.count() == n
    ratio = back.filter("era = 1995").agg(F.sum("sumw")).first()[0] / hist.filter("era = 1995").agg(F.sum("sumw")).first()[0]
    assert ratio == pytest.approx(2.0)
    with pytest.raises(ValueError):
        ST.add_loaded(back, back)
    ST.save(H.with_edges(hist.filter("era = 1996").drop("x_lo", "x_hi"), Axis("w", 5, 0.0, 6.0)), path)
    with pytest.raises(ValueError, match="binnings"):
        ST.load(spark, path)


def test_snapshot_keeps_requested_columns_that_exist(spark, sf, tmp_path):
    ST.snapshot(heads(spark, sf, "w", "era"), str(tmp_path / "s"), ["w", "nope"], max_rows=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == ["w"] and len(back.inputFiles()) >= 3
    ST.report(back.limit(2), str(tmp_path / "r"))
    ST.report(back.limit(2), str(tmp_path / "j"), "json")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 2


def test_incremental_skim_takes_each_file_once(spark, sf, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    ev = heads(spark, sf, "w")
    ev.filter("k % 2 = 0").write.parquet(src)
    steps = StepList([("define", "w2", "w * 2"), ("cut", "c", "w2 > 2")])
    run = lambda: skim_new_files(spark, src, ev.schema, steps, out, ck, "w", ["k", "w2"])
    run()
    run()
    first = spark.read.parquet(f"{out}/rows").count()
    assert first == ev.filter("k % 2 = 0 AND w * 2 > 2").count()
    ev.filter("k % 2 = 1").write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(f"{out}/rows").count() == ev.filter("w * 2 > 2").count()
    total = spark.read.parquet(f"{out}/ledger").agg(F.sum("sum_w")).first()[0]
    assert total == pytest.approx(ev.agg(F.sum("w")).first()[0])


def test_parallel_arrays_become_records(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.1, 0.2])], "Jet_pt array<double>, Jet_eta array<double>")
    r = from_parallel_arrays(df, "Jet").first()
    assert r["nJet"] == 2 and [x["pt"] for x in r["Jet"]] == [1.0, 2.0] and r["Jet"][1]["eta"] == 0.2


def test_job_type_accepts_flags_and_maps():
    assert JobType.of(0) is JobType.MC and JobType.of({"a": 1}) is JobType.DATA and JobType.of(False, 1) is JobType.DATA_DRIVEN
    with pytest.raises(ValueError):
        JobType.of(1, 1)


def test_skim_job_branches(spark, sf):
    job = SkimJob(StepList([("cut", "c", "w > 1")]), ["k", "w", "nope"], is_data=True, data_filter=lambda d: d.filter("k % 2 = 0"))
    ev = heads(spark, sf, "w")
    assert job.rows(ev).count() == ev.filter("w > 1 AND k % 2 = 0").count()
    assert job.rows(ev).columns == ["k", "w"]


def test_corrections_skip_what_exists_and_pass_known_options(spark):
    df = spark.createDataFrame([(5.0, 7.0)], "n_true double, pu_weight double")
    from eventloom.operators.lookup import BinnedTable

    t = BinnedTable([("n", (0.0, 50.0, 100.0))], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [("v", ["nominal", "up", "down"])])
    out = C.apply_corrections(df, ["pileup"], C.Context(tables={"pileup": t}, options={"pileup": {"unknown": 1}})).first()
    assert (out["pu_weight"], out["pu_weight_up"], out["pu_weight_down"]) == (7.0, 3.0, 5.0)


def test_smear_draws_are_normal_and_reproducible(spark):
    from eventloom.operators.scale import keyed_uniform

    df = spark.range(20000)
    u1, u2 = keyed_uniform(F.col("id"), seed="u1"), keyed_uniform(F.col("id"), seed="u2")
    z = F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(F.lit(6.283185307179586) * u2)
    r = df.agg(F.avg(z).alias("m"), F.stddev(z).alias("s")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03


def test_skim_of_bad_files(spark, tmp_path):
    """A truncated table, a file that is none, an empty one; a second run after repair."""
    from eventloom.sources import skimrun as K

    src, store = tmp_path / "in", str(tmp_path / "out")
    rows = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("w"), F.array(F.struct("id", F.lit("é").alias("s"))).alias("objects"))
    for name, part in (("a", rows.where("id < 1000")), ("b", rows.where("id >= 1000")), ("e", rows.where("false"))):
        part.coalesce(1).write.parquet(str(src / name))
    (whole,) = (src / "b").glob("part-*")
    data = whole.read_bytes()
    (src / "b" / f".{whole.name}.crc").write_bytes(b"")
    whole.write_bytes(data[: len(data) // 2])
    (src / "junk").mkdir()
    (src / "junk" / "part-0.parquet").write_bytes(b"no table")
    listing = lambda: K.listed(spark, str(src), "part-*")
    name = lambda p: p.rsplit("/", 2)[1]
    states = lambda: {name(r["path"]): (r["state"], r["n_rows"], r["sum_w"], r["n_kept"]) for r in K.manifest(spark, store).collect()}
    assert K.manifest(spark, store).count() == 0 and K.due(listing(), store).count() == 4
    skim = lambda files: K.run_skim(K.tolerant_events(spark, str(src), rows.schema, "part-*").join(files.select(F.col("path").alias("source")), "source", "left_semi"), files, store, F.col("w") > 2, ["id", "objects"], F.col("w"))
    first = skim(listing())
    w = lambda a, b: [float(k % 7) for k in range(a, b)]
    a_row = ("ok", 1000, sum(w(0, 1000)), sum(x > 2 for x in w(0, 1000)))
    assert states() == {"a": a_row, "b": ("no_rows", None, None, None), "e": ("no_rows", None, None, None), "junk": ("no_rows", None, None, None)}
    # a run that was written but never committed does not count
    K.split_rows(K.tolerant_events(spark, str(src), rows.schema, "part-*"), F.lit(True), ["id", "objects"], F.col("w")).write.partitionBy("kind").parquet(f"{store}/runs/{'0' * 32}")
    assert sorted(r["id"] for r in K.kept_rows(spark, store).collect()) == [k for k in range(1000) if k % 7 > 2]
    # repaired input: only what is due runs again
    whole.write_bytes(data)
    (src / "b" / f".{whole.name}.crc").unlink()
    again = K.due(listing(), store)
    assert sorted(name(r["path"]) for r in again.collect()) == ["b", "e", "junk"]
    assert skim(again) != first
    assert states()["b"] == ("ok", 2000, sum(w(1000, 3000)), sum(x > 2 for x in w(1000, 3000))) and states()["a"] == a_row
    kept = K.kept_rows(spark, store).collect()
    assert sorted(r["id"] for r in kept) == [k for k in range(3000) if k % 7 > 2] and kept[0]["objects"][0]["s"] == "é"


def test_incomplete_output_is_set_aside(spark, tmp_path):
    from eventloom.sources import skimrun as K

    rows = spark.range(50).select("id", F.lit(1.0).alias("w"), F.when(F.col("id") < 20, "x").otherwise("y").alias("source"))
    listing = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "path string, length int")
    parts = K.split_rows(rows, F.col("id") % 2 == 0, ["id"], F.col("w"))
    lost = parts.where("NOT (kind = 'events' AND source = 'x' AND row.id = 4)")
    lost.write.partitionBy("kind").parquet(f"{tmp_path}/runs/{'a' * 32}")
    K.commit(spark, str(tmp_path), "a" * 32, listing)
    assert {r["path"]: (r["state"], r["n_kept"]) for r in K.manifest(spark, str(tmp_path)).collect()} == {"x": ("incomplete", 10), "y": ("ok", 15), "z": ("no_rows", None)}
    assert {r["source"] for r in K.kept_rows(spark, str(tmp_path)).collect()} == {"y"}
    assert sorted(r["path"] for r in K.due(listing, str(tmp_path)).collect()) == ["x", "z"]


def test_skim_reads_the_events_once(spark, sf):
    from eventloom.sources import skimrun as K

    ev = spark.read.parquet(f"{sf}/orders.parquet").withColumn("source", F.col("_metadata.file_path"))
    df = K.split_rows(ev, F.col("o_totalprice") > 1e5, ["o_orderkey"], F.col("o_totalprice"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "o_orderdate" not in plan
