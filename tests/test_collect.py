"""The collect job: configuration, skip report, plan, and missing values."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis
from eventloom.operators.steps import StepList
from eventloom.plans import collecting
from eventloom.plans.collect import CHUNK, CollectJob, ShiftSource, Variable, WeightSource, collect, collected_channels, usable_variations, variables

STEPS = StepList([("cut", "some", "x > 1")])


def job(**more):
    return CollectJob([("a", ""), ("b", "g")], [Variable(Axis("x", 4, 0.0, 8.0))], STEPS, ("w",), **more)


def frame(spark, rows, schema="channel string, x double, w double"):
    return spark.createDataFrame(rows, schema)


def test_channels_keep_the_order_of_the_top_level():
    groups = {"m": ["b", "a"], "k": ["c"]}
    assert collected_channels(["z", "m", "k"], groups) == [("z", ""), ("b", "m"), ("a", "m"), ("c", "k")]
    assert collected_channels(["z", "m", "k"], groups, ["k", "z"]) == [("z", ""), ("c", "k")]
    with pytest.raises(ValueError, match="not a top-level"):
        collected_channels(["z", "m"], groups, ["a"])


def test_configuration_errors():
    steps, axes = StepList(), {"x": {"nBins": 2, "min": 0, "max": 1}}
    base = {"datasets": ["a"], "MCweight": ["w", "f"], "DDweight": ["d"], "varNames": ["x"]}
    make = lambda **more: CollectJob.from_config(base | more, steps, axes, {"ALL": ["s", "t"]}, {"s": "corr"})
    assert make().factors == ("w", "f") and make(isDD=1).weight == "DDTotalWeight" and make(isDD=1).factors == ("d",)
    assert make(isData=True).factors == () and make(isData=True, weightSyst={"s": "w"}).weight_sources == []
    made = make(weightSyst={"ALL": "f"}, shiftSyst={"ALL": ["x"]}, shiftWeightSyst={"ALL": ["f"]})
    assert [s.name for s in made.weight_sources] == ["s", "t"]
    assert [(s.name, s.ratio, s.weights) for s in made.shift_sources] == [("s", "corr", ("f", "f_s_up", "f_s_down")), ("t", None, ("f", "f_t_up", "f_t_down"))]
    assert make(shiftSyst={"s": ["x"]}, shiftWeightSyst={"s": ["w", "hi", "lo"]}).shift_sources[0].weights == ("w", "hi", "lo")
    for bad in (
        {"varNames": []},
        {"varNames_2D": [["x"]]},
        {"MCweight": []},
        {"isData": 1, "isDD": 1},
        {"shiftSyst": {"ALL": ["x"], "t": ["x"]}},
        {"shiftSyst": {"s": []}},
        {"shiftWeightSyst": {"ALL": ["w", "hi", "lo"]}},
        {"shiftWeightSyst": {"s": ["w", "hi"]}},
        {"shiftWeightSyst": {"s": ["other"]}},
        {"shiftWeightSyst": {"ALL": ["w"], "s": ["f"]}},
    ):
        with pytest.raises(ValueError):
            make(**bad)


def test_names_of_shifted_weights():
    assert WeightSource("btag_hf", "btag_weight").column("up") == "btag_weight_hf_up"
    assert WeightSource("CMS_x", "JVMweight").column("down") == "JVMweight_x_down"
    assert WeightSource("pu", "pu").column("up") == "pu_up" and WeightSource("s", "pu").column("up") == "pu_s_up"


def test_shifts_are_judged_by_direction(spark):
    kinds = "channel string, x double, s double, r double, r_up double, coll array<struct<y:double,s:double>>, w double"
    shifts = [ShiftSource("s", ("x", "coll.y")), ShiftSource("q", ("x",), ratio="r"), ShiftSource("s2", ("coll.z",)), ShiftSource("s", ("x",), weights=("w", "w_hi", "w"))]
    good, rows = usable_variations(frame(spark, [], kinds).schema, job(shift_sources=shifts))
    assert [(d, s.name) for _, d, s in good] == [("up", "s"), ("down", "s"), ("up", "q"), ("down", "s")]
    assert [r[4] for r in rows] == ["", "", "", "missing r_down", "missing coll.z, coll.s2", "missing coll.z, coll.s2", "missing w_hi", ""]


def test_one_scan_and_one_exchange(spark, sf):
    df = collecting.collect_whole_job(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1
    assert plan.count(" Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_weights_in_several_entries(spark):
    """More weights than one entry sums, against single sums."""
    n = 2 * CHUNK + 1
    sources = [WeightSource(f"s{k}", "w") for k in range(n)]
    rows = [("a", 1.5, 2.0), ("a", 2.5, 3.0), ("b", 100.0, 1.0), ("a", 0.5, 9.0), ("c", 3.0, 1.0), ("a", None, 1.0), (None, 3.0, 1.0)]
    df = frame(spark, rows)
    for k in range(n):
        df = df.withColumns({f"w_s{k}_up": F.col("w") + k, f"w_s{k}_down": F.col("w") * k})
    hist, report = collect(df, job(weight_sources=sources), factor=frame(spark, [("a", 10.0)], "channel string, factor double"))
    got = {(r["place"], r["sample"], r["weight"], r["ix"]): (r["sumw"], r["sumw2"], r["n"]) for r in hist.collect()}
    want = {}
    for k in range(-1, n):
        for d in ("up", "down") if k >= 0 else ("",):
            move = lambda w: w if k < 0 else w + k if d == "up" else w * k
            name = "MCTotalWeight" + (f"_s{k}_{d}" if d else "")
            want[0, "", name, 1] = (10 * move(2.0), 100 * move(2.0) ** 2, 1)
            want[0, "", name, 2] = (10 * move(3.0), 100 * move(3.0) ** 2, 1)
            want[1, "g", name, 4] = (move(1.0), move(1.0) ** 2, 1)
    assert got == want and report.count() == 2 * n


def test_channel_without_a_column_has_no_such_variation(spark):
    df = frame(spark, [("a", 2.0, 1.0, 0.5, 2.0, 3.0), ("b", 2.0, 1.0, None, None, 3.0)], "channel string, x double, w double, rel double, w_s_up double, w_s_down double")
    hist, _ = collect(df, job(weight_sources=[WeightSource("s", "w")], shift_sources=[ShiftSource("rel", ("x",))]))
    got = {(r["channel"], r["weight"]): (r["ix"], r["sumw"]) for r in hist.collect()}
    assert got == {
        ("a", "MCTotalWeight"): (2, 1.0), ("b", "MCTotalWeight"): (2, 1.0), ("a", "MCTotalWeight_s_up"): (2, 2.0), ("a", "MCTotalWeight_s_down"): (2, 3.0),
        ("b", "MCTotalWeight_s_down"): (2, 3.0), ("a", "MCTotalWeight_rel_up"): (2, 1.0),
    }


def test_data_counts_events_and_empty_tables(spark):
    df = frame(spark, [("a", 2.0, 7.0), ("a", 2.5, 7.0)])
    data = CollectJob([("a", "")], variables({"x": {"nBins": 4, "min": 0, "max": 8}}, ["x"], [["x", "x"]]), STEPS, (), "one")
    got = sorted((r["weight"], r["var"], r["ix"], r["iy"] or 0, r["sumw"], r["n"]) for r in collect(df, data)[0].collect())
    assert got == [("one", "x", 2, 0, 2.0, 2), ("one", "x_vs_x", 2, 2, 2.0, 2)]
    hist, report = collect(df.where("false"), data)
    assert hist.collect() == [] and report.collect() == []
