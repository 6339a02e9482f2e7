"""Edge cases on small literal frames."""

import datetime
import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import kinematics as K
from eventloom.functions import vectors as V
from eventloom.functions.binning import Axis
from eventloom.operators import features as X
from eventloom.operators import fit as T
from eventloom.operators import histalgebra as A
from eventloom.operators import histogram as H
from eventloom.operators import joins as J
from eventloom.operators import lookup as L
from eventloom.operators import optimise as O
from eventloom.operators import splits as SP
from eventloom.operators import steps as S
from eventloom.operators import variations as VA
from eventloom.operators import weights as W
from eventloom.operators.scale import attach_totals, kth_value, ordered_rank, running_totals, values_table


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*xs, kind="int"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


def test_angle_wraps_into_half_open_range(spark):
    r = one(
        spark,
        a=K.delta_phi(F.lit(3.1), F.lit(-3.1)),
        pi=K.delta_phi(F.lit(math.pi), F.lit(0.0)),
        mpi=K.delta_phi(F.lit(-math.pi), F.lit(0.0)),
        folded=K.folded_delta_r(F.lit(0.0), F.lit(3.1), F.lit(0.0), F.lit(-3.1)),
    )
    assert r["a"] == pytest.approx(6.2 - 2 * math.pi)
    assert r["pi"] == pytest.approx(math.pi) and r["mpi"] == pytest.approx(math.pi)
    assert r["folded"] == pytest.approx(2 * math.pi - 6.2)


def test_axis_edges_flow_and_nan(spark):
    fixed, var = Axis("x", 4, 0.0, 2.0), Axis("x", edges=(0.0, 0.5, 2.0))
    xs = [-1.0, 0.0, 0.5, 1.999, 2.0, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(8, None)], "i int, x double")
    rows = {r["i"]: r for r in df.select("i", fixed.index(F.col("x")).alias("f"), var.index(F.col("x")).alias("v"), fixed.clamped_index(F.col("x")).alias("c")).collect()}
    assert [rows[i]["f"] for i in range(9)] == [0, 1, 2, 4, 5, 5, 0, 5, None]
    assert [rows[i]["v"] for i in range(9)] == [0, 1, 2, 2, 3, 3, 0, 3, None]
    assert [rows[i]["c"] for i in range(9)][:7] == [1, 1, 2, 4, 4, 4, 1]


def test_region_includes_last_edge(spark):
    a = Axis("x", edges=(0.0, 1.0, 2.0))
    r = one(spark, lo=a.region(F.lit(0.0)), last=a.region(F.lit(2.0)), out=a.region(F.lit(2.1)), below=a.region(F.lit(-0.1)))
    assert (r["lo"], r["last"], r["out"], r["below"]) == (0, 1, None, None)


@pytest.mark.parametrize(
    "spec",
    [{"nBins": "0", "min": "0", "max": "1"}, {"nBins": "3"}, {"nBins": "3", "min": "1", "max": "1"}, {"binning": [0, 2, 1]}, {"nBins": "3", "binning": [0, 1, 2]}, {"binning": [0, float("inf")]}],
)
def test_bad_binning_is_an_error(spec):
    with pytest.raises(ValueError):
        Axis.from_config("x", spec)


def test_positions_and_links_on_empty_and_invalid(spark):
    objs = F.array(*[F.struct(F.lit(p).alias("pt"), F.lit(i).cast("int").alias("link")) for p, i in ((10.0, -1), (20.0, 5), (30.0, 0))])
    empty = F.array().cast("array<boolean>")
    r = one(
        spark,
        none=V.kth_position(arr(False, True, kind="boolean"), 1),
        first=V.first_true(empty),
        pos=V.positions(empty),
        pt=V.linked_field(objs, "link", objs, "pt", -999.0),
        kept=V.keep_link(arr(-1, 5, 0), arr(True, False, True, kind="boolean")),
        top=F.size(V.top_by(objs, "pt", 4)),
        best=V.top_by(objs, "pt", 1)[0]["pt"],
    )
    assert r["none"] is None and r["first"] == -1 and r["pos"] == []
    assert r["pt"] == [-999.0, -999.0, 10.0]
    assert r["kept"] == [-1, -1, 0]
    assert r["top"] == 3 and r["best"] == 30.0


def test_walk_stops_on_a_cycle_and_at_the_root(spark):
    r = one(
        spark,
        cycle=V.ancestry_flavour(F.lit(0), arr(11, 12), arr(1, 0)),
        c=V.ancestry_flavour(F.lit(0), arr(11, 411), arr(1, 0)),
        b=V.ancestry_flavour(F.lit(2), arr(521, 411, 11), arr(-1, 0, 1)),
        none=V.ancestry_flavour(F.lit(-1), arr(521), arr(-1)),
        src=V.trace_origin(F.lit(2), arr(25, 5, 521), arr(-1, 0, 1)),
        soft=V.trace_origin(F.lit(0), arr(521), arr(-1)),
        terminal=V.terminal_sources(arr(25, 521, 511), arr(-1, 0, 1)),
        prompt=V.ancestry_flavour(F.lit(0), arr(13), arr(-1), arr(1)),
        tau=V.ancestry_flavour(F.lit(0), arr(13), arr(-1), arr(32 + 1)),
    )
    assert (r["cycle"], r["c"], r["b"], r["none"]) == (3, 4, 5, 0)
    assert (r["src"], r["soft"]) == (25, 1)
    assert r["terminal"] == [0, 0, 25]
    assert (r["prompt"], r["tau"]) == (1, 15)


def test_quadrature_of_different_sizes_raises(spark):
    with pytest.raises(Exception, match="different size"):
        one(spark, q=V.quadrature(arr(1.0, 2.0, kind="double"), arr(1.0, kind="double")))


def test_steps_validate():
    with pytest.raises(ValueError):
        S.StepList([("explode", "x", "y")])
    with pytest.raises(ValueError):
        S.StepList([("TLVPtEtaPhiM", "v", "a,b,c")])


def test_redefine_needs_the_column_and_hoisting_differs(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    with pytest.raises(ValueError):
        S.apply_steps(df, S.StepList([("redefine", "b", "a")]))
    steps = S.StepList([("define", "x", "a"), ("cut", "c", "x > 2"), ("redefine", "x", "x + 10")])
    assert [r["x"] for r in S.apply_steps(df, steps).collect()] == [13.0]
    assert sorted(r["x"] for r in S.apply_steps(df, steps.hoisted()).collect()) == [11.0, 13.0]


def test_variant_without_cuts_passes_all_and_keeps_nominal(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, a_up double")
    out = S.apply_variant(df, S.StepList([("define", "b", "a * 2"), ("define", "a", "a + 1"), ("define", "c", "a")]), "_v", {"a": "a_up"}, flags=True)
    r = out.first()
    assert (r["a"], r["a_up"], r["b_v"], r["a_v"], r["c_v"], r["pass_all_v"]) == (1.0, 2.0, 4.0, 3.0, 3.0, True)


def test_envelope_keeps_every_variation(spark, sf):
    """The pre-selection is a superset of the selection under any single source."""
    from eventloom.plans.tables import nested

    ev = nested(spark, sf, "pt", "rel", "score").withColumn("obj", F.transform("obj", lambda o: o.withField("src2", o["score"] / 20.0)))
    kept = {r["k"] for r in S.envelope_filter(ev, "obj", "pt", ["rel", "src2"], lambda o: o["score"] >= 0.0, 3, 30.0).select("k").collect()}
    for shift in (lambda o: 1 + o["rel"], lambda o: 1 - o["rel"], lambda o: 1 + o["src2"], lambda o: F.lit(1.0)):
        sel = ev.filter(F.size(F.filter("obj", lambda o: o["pt"] * shift(o) > 30.0)) >= 3).select("k").collect()
        assert {r["k"] for r in sel} <= kept


def test_first_and_last_duplicate(spark):
    src = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string")
    tgt = spark.createDataFrame([(1,), (2,)], "k int")
    get = lambda last: {r["k"]: r["v"] for r in J.lookup_by_key(tgt, src, ["k"], {"v": F.lit("-")}, F.col("o"), last).collect()}
    assert get(False) == {1: "a", 2: "-"} and get(True) == {1: "b", 2: "-"}


def test_alias_errors(spark):
    with pytest.raises(ValueError):
        J.expand_nested(["a"], {"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        J.expand_nested(["group:x"], {})
    aliases = spark.createDataFrame([("all", ["x", "y"])], "alias string, members array<string>")
    names = spark.createDataFrame([("all",), ("x",)], "source string")
    with pytest.raises(Exception, match="duplicate"):
        J.expand_aliases(names, "source", aliases).collect()


def test_table_flow_and_unknown_key(spark):
    clamp = L.BinnedTable([("x", (0.0, 1.0, 2.0))], [1.0, 2.0], flow="clamp")
    error = L.BinnedTable([("x", (0.0, 1.0, 2.0))], [1.0, 2.0], flow="error")
    keyed = L.BinnedTable([("x", (0.0, 1.0))], [1.0, 2.0], [("k", ["a", "b"])])
    r = one(spark, lo=clamp.at(F.lit(-5.0)), hi=clamp.at(F.lit(9.0)), edge=clamp.at(F.lit(1.0)), unknown=keyed.at(F.lit("z"), F.lit(0.5)), b=keyed.at(F.lit("b"), F.lit(0.5)))
    assert (r["lo"], r["hi"], r["edge"], r["unknown"], r["b"]) == (1.0, 2.0, 2.0, None, 2.0)
    with pytest.raises(Exception, match="outside the table"):
        one(spark, v=error.at(F.lit(2.0)))
    with pytest.raises(ValueError):
        L.BinnedTable([("x", (0.0, 1.0))], [1.0, 2.0])


def test_zero_denominators(spark):
    df = spark.createDataFrame([("n", 1, 3.0, 3.0, 1), ("d", 1, 0.0, 0.0, 1)], "c string, ix int, sumw double, sumw2 double, n long")
    r = A.ratio(df, ["ix"], F.col("c") == "n", F.col("c") == "d").first()
    assert (r["ratio"], r["error"]) == (0.0, 0.0)
    assert one(spark, s=W.mc_scale(F.lit(2.0), F.lit(3.0), F.lit(0.0)))["s"] == 1.0
    assert one(spark, z=O.asimov(F.lit(1.0), F.lit(0.0)))["z"] == 0.0


def test_fold_keeps_sums(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (4, 3.0), (5, 4.0)], "ix int, sumw double").withColumns({"sumw2": F.col("sumw"), "n": F.lit(1)})
    got = {r["ix"]: (r["sumw"], r["sumw2"], r["n"]) for r in H.fold_flow(df, [], 4).collect()}
    assert got == {1: (3.0, 3.0, 2), 4: (7.0, 7.0, 2)}


def test_crop_errors():
    ax = Axis("x", 4, 0.0, 4.0)
    for lo, hi in ((-1.0, 2.0), (1.0, 9.0), (1.2, 1.8)):
        with pytest.raises(ValueError):
            A.crop(None, ax, lo, hi)


def test_singular_fit_raises(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (2.0, 2.0, 2.0, 1.0)], "r0 double, r1 double, value double, sigma double")
    with pytest.raises(ValueError, match="singular"):
        T.solve(rows, 2)
    with pytest.raises(ValueError):
        T.rate_uncertainty({"a": [0.9, 1.1], "b": [0.8, 1.2]}, {"p": ["a", "b"]}, ["p"])


def test_feature_groups_must_partition():
    with pytest.raises(ValueError):
        X.check_groups({"a": ["x"], "b": ["x", "y"]}, ["x", "y"])
    assert len(X.FEATURES) == 61


def test_variation_names():
    assert VA.shifted_weight_name("JVMweight", "CMS_scale_j", "up") == "JVMweight_scale_j_up"
    assert VA.shifted_weight_name("btag_weight", "btag_jes", "down") == "btag_weight_jes_down"
    assert VA.shifted_field_name("Jet_pt", "src", "up") == "Jet_src_up_pt"
    with pytest.raises(ValueError):
        VA.shifted_value(F.lit(1.0), "up")


def test_simplex_grid():
    assert len(O.simplex_grid(0.25, 3)) == 15
    assert all(abs(sum(p) - 1) < 1e-9 for p in O.simplex_grid(0.1, 3))
    with pytest.raises(ValueError):
        O.simplex_grid(0.3, 2)


def test_equal_content_errors(spark):
    few = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, w double")
    with pytest.raises(ValueError):
        O.equal_content_edges(few, "x", "w", 5)
    with pytest.raises(ValueError):
        O.equal_content_edges(spark.createDataFrame([(1.0, -1.0), (2.0, 5.0), (3.0, 1.0)], "x double, w double"), "x", "w", 2, "signed")


# --- skew ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one class and one value."""
    return spark.range(20000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("c"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 100.0).alias("x")
    )


def test_running_totals_on_a_hot_value(spark, skewed):
    by_value = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = {r["x"]: r["cum"] for r in running_totals(by_value, "x", {"cum": "n"}).collect()}
    cum = 0
    for r in sorted(by_value.collect(), key=lambda r: r["x"]):
        cum += r["n"]
        assert got[r["x"]] == cum
    down = {r["x"]: r["cum"] for r in running_totals(by_value, "x", {"cum": "n"}, descending=True).collect()}
    assert down[min(down)] == 20000


def test_split_of_a_hot_class_is_spread_and_exact(spark, skewed):
    out = SP.stratified_split(skewed, ["c"], ["id"], 0.1, 0.2, 1)
    n = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert (n["hot", "train"], n["hot", "val"], n["hot", "test"]) == (7000, 1000, 2000)
    assert sum(n.values()) == 20000


def test_tiny_stratum_keeps_a_training_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, c string")
    out = {r["id"]: r["split"] for r in SP.stratified_split(df, ["c"], ["id"], 0.5, 0.5, 1).collect()}
    assert sorted(v for k, v in out.items() if k < 3) == ["train", "val"]


def test_kth_value_and_ordered_rank(spark, skewed):
    xs = sorted(r["x"] for r in skewed.collect())
    for k in (1, 200, 501, 9000, 20000):
        assert kth_value(skewed, "x", k, exact_rows=50) == xs[k - 1]
    got = {r["id"]: r["r"] for r in ordered_rank(skewed, "r", ["id"]).collect()}
    assert all(got[i] == i + 1 for i in range(0, 20000, 997))


def test_totals_without_a_window(spark, skewed):
    out = attach_totals(skewed, ["c"], n=F.count(F.lit(1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert out.filter("c = 'hot'").first()["n"] == 10000 and out.count() == 20000


def test_totals_for_any_key_type(spark):
    rows = [(d, t, c, a, i) for i, (d, t, c, a) in enumerate([(datetime.date(2020, 1, 1), datetime.datetime(2020, 1, 1, 3), decimal.Decimal("1.50"), [1, 2]), (None, None, None, None)] * 5)]
    df = spark.createDataFrame(rows, "d date, t timestamp, c decimal(12,2), a array<int>, i int")
    for key in ("d", "t", "c", "a"):
        out = attach_totals(df, [key], n=F.count(F.lit(1))).collect()
        assert len(out) == 10 and {r["n"] for r in out} == {5}


def test_missing_group_keys_keep_their_rows(spark):
    df = spark.range(20).withColumn("s", F.when(F.col("id") % 2 == 0, "a")).withColumn("w", F.lit(1.0))
    out = SP.stratified_split(df, ["s"], ["id"], 0.2, 0.2, 3)
    assert sorted(r["id"] for r in out.collect()) == list(range(20))
    assert {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()} == {(s, k): n for s in ("a", None) for k, n in (("train", 6), ("val", 2), ("test", 2))}
    curve = O.cut_scan(df.withColumn("b", F.lit(1.0)), "id", "w", "b", 4, ["s"])
    assert {r["s"] for r in curve.collect()} == {"a", None}
    sums = running_totals(df, "id", {"c": "w"}, ["s"]).collect()
    assert len(sums) == 20 and max(r["c"] for r in sums) == 10.0


def test_empty_bins_are_zero(spark):
    rows = [("nominal", "", 1, 10.0), ("nominal", "", 2, 4.0), ("s", "up", 2, 5.0), ("s", "down", 1, 8.0), ("s", "down", 3, 2.0), ("one", "up", 1, 99.0)]
    hists = spark.createDataFrame([(*r, 1.0) for r in rows], "source string, direction string, ix int, sumw double, sumw2 double")
    band = {r["ix"]: (r["nominal"], r["err_up"], r["err_down"]) for r in A.uncertainty_band(hists, ["ix"]).collect()}
    assert band == {1: (10.0, 0.0, 10.0), 2: (4.0, 1.0, 4.0), 3: (0.0, 2.0, 0.0)}
    most = {r["ix"]: (r["upper"], r["lower"]) for r in A.max_variation(hists.filter("source <> 'one'"), ["ix"]).collect()}
    assert most == {1: (10.0, 0.0), 2: (5.0, 0.0), 3: (2.0, 0.0)}
    few = spark.createDataFrame([("a", 1, 3.0, 9.0, 1)], "channel string, ix int, sumw double, sumw2 double, n long")
    out = A.blind(few, Axis("x", 4, 0.0, 4.0), [(0.4, 1.6)], ["channel"]).collect()
    assert sorted((r["ix"], r["sumw"], r["sumw2"], r["n"]) for r in out) == [(1, -1.0, 0.0, 1), (2, -1.0, 0.0, 0)]


def test_eras_and_binnings_are_checked(spark):
    rows = [("mc", 1, 1, 2.0, 1.0, 1, 0.0, 1.0), ("mc", 2, 1, 9.0, 1.0, 1, 0.0, 1.0), ("obs", 1, 1, 3.0, 1.0, 1, 0.0, 1.0), ("obs", 2, 1, 4.0, 1.0, 1, 0.5, 1.0)]
    hists = spark.createDataFrame(rows, "channel string, era int, ix int, sumw double, sumw2 double, n long, x_lo double, x_hi double")
    out = A.combine_eras(hists, ["ix"], {"mc": "stack", "obs": "data"}, {1: 2.0, 2: 6.0}, {"stack": [1], "data": [1, 2]}, [1, 2], {"mc": 0.5})
    assert {r["role"]: (r["sumw"], r["sumw2"]) for r in out.collect()} == {"stack": (4.0, 4.0), "data": (7.0, 2.0)}
    with pytest.raises(ValueError):
        A.combine_eras(hists, ["ix"], {"mc": "stack"}, {1: 2.0}, {"stack": [3]}, [1])
    assert A.merge(hists.filter("channel = 'mc'"), {}, ["ix"], edges=["x_lo", "x_hi"]).first()["sumw"] == 11.0
    with pytest.raises(Exception, match="bins of different x_lo"):
        A.merge(hists, {}, ["ix"], edges=["x_lo", "x_hi"]).collect()


def test_weight_vectors_and_distinct_edges():
    assert O.simplex_grid(0.5, 2) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)] and O.simplex_grid(0.25, 1) == [(1.0,)]
    grid = O.simplex_grid(0.1, 4)
    assert len(grid) == len(set(grid)) == 286 and all(abs(sum(g) - 1) < 1e-9 for g in grid)
    got = O._apart(np.array([1.0, 1.0, -1.0, 5.0]), 0.0, 9.0)
    assert got[0] == 1.0 and got == sorted(set(got)) and abs(got[2] - 1.0) < 1e-12 and got[3] == 5.0
    with pytest.raises(ValueError):
        O._apart(np.array([9.0]), 0.0, 9.0)


def test_scores_of_missing_features(spark):
    from eventloom.operators.scoring import dense_scores

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None])], "i int, f array<double>")
    out = {r["i"]: r["s"] for r in df.select("i", dense_scores(F.col("f"), [([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])]).alias("s")).collect()}
    assert out[2] is None and out[3] is None and sum(out[1]) == pytest.approx(1.0)
    table = L.BinnedTable([("x", [0.0, 1.0])], [3.0, 4.0], [("k", ["a\\b", "it's"])])
    got = spark.createDataFrame([("a\\b",), ("it's",), ("no",), (None,)], "k string").select(table.at(F.col("k"), F.lit(0.5)).alias("v")).collect()
    assert [r["v"] for r in got] == [3.0, 4.0, None, None]


def test_large_tables_are_looked_up(spark):
    n = 150
    table = L.BinnedTable([("x", list(range(n + 1))), ("y", list(range(n + 1)))], [float(i) for i in range(n * n)])
    out = spark.range(n).select((table.at(F.col("id") + 0.5, F.lit(3.5))).alias("v")).collect()
    assert [r["v"] for r in out] == [i * n + 3.0 for i in range(n)]


def test_values_table_is_a_local_relation(spark):
    t = values_table(spark, "a string, b double", [("x", float("inf")), ("y", None)])
    assert "LocalTableScan" in t._jdf.queryExecution().executedPlan().toString()
    assert t.filter("a = 'x'").first()["b"] == float("inf")


def test_ranges_of_all_features():
    """Every feature has its fixed range, whatever patterns its name fits."""
    from eventloom.operators import quality as Q

    assert set(Q.FEATURE_RANGES) | set(Q.FEATURE_COUNTS) == set(X.FEATURES)
    want = {"lead_mu_pz": (-500.0, 500.0), "jet3_pz": (-500.0, 500.0), "sublead_mu_px": (-200.0, 200.0), "sublead_mu_py": (-200.0, 200.0), "sublead_mu_pz": (-400.0, 400.0), "lead_mu_px": (-400.0, 400.0), "jet1_dr_mu2": (0.0, 5.0), "bjet_m_13": (0.0, 400.0), "jet4_mass": (0.0, 50.0), "jet2_btag": (0.0, 1.0), "jet_cent": (0.0, 1.0), "dimuon_mass": (0.0, 400.0), "sumjet_pt": (0.0, 1500.0), "sumbjet_pt": (0.0, 1000.0), "lead_mu_jetDF": (-400.0, 400.0), "some_dr": (0.0, 5.0), "jet9_pz": (-500.0, 500.0), "other": (-400.0, 400.0)}
    assert {n: (Q.default_feature_axis(n).lo, Q.default_feature_axis(n).hi) for n in want} == want
    assert Q.default_feature_axis("nBJet") == Axis("nBJet", 3, 2.5, 5.5) and Q.default_feature_axis("nGoodJet").n == 7


@pytest.mark.parametrize("chunk", [3, 40, 1000])
def test_interval_search_against_all_ranges(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(L, "RANGE_CHUNK", chunk)
    rnd = random.Random(2)
    ranges = [(run, lo, lo + rnd.randint(-2, 30), float(k)) for k, (run, lo) in enumerate((rnd.randint(1, 3), rnd.randint(0, 400)) for _ in range(260))]
    rows = [(k, rnd.choice([1, 2, 3, 4, None]), rnd.choice([None, *range(-5, 450)])) for k in range(900)]
    table = spark.createDataFrame(ranges, "run int, lo int, hi int, value double")
    df = spark.createDataFrame(rows, "k int, run int, block int")
    inside = {k for k, run, b in rows if b is not None and any(r == run and lo <= b <= hi for r, lo, hi, _ in ranges)}
    assert {r["k"] for r in L.in_ranges(df, "run", "block", table).collect()} == inside
    got = {r["k"]: r["v"] for r in L.interval_value(df, "run", "block", {"v": table}, -7.0).collect()}
    for k, run, b in rows:
        begun = [(lo, hi, v) for r, lo, hi, v in ranges if b is not None and r == run and lo <= b]
        last = max(begun, default=None)
        assert got[k] == (last[2] if last and b <= last[1] else -7.0)
    none = table.where("false")
    assert L.in_ranges(df, "run", "block", none).count() == 0
    assert {r["v"] for r in L.interval_value(df, "run", "block", {"v": none}, 1.5).collect()} == {1.5}


def _long_list(spark):
    """4000 overlapping ranges, all but a few of one run, and blocks that are asked for
    often or are not numbers."""
    ranges = spark.range(4000).selectExpr("if(id % 500 = 0, 2, 1) run", "cast(id * 5 as double) lo", "cast(id * 5 + id % 7 as double) hi", "cast(id as double) value")
    rows = [(k, 1, float(b)) for k, b in enumerate([-1, 4, 5, 6, 9.5, 19999, 1e9, *[5005] * 500, *range(20000, 20010)])]
    return ranges, spark.createDataFrame([*rows, (900, 1, math.nan), (901, 2, 2.5), (902, 3, 5.0), (903, None, 5.0)], "k int, run int, block double")


def _dealt(df):
    """No list of a run is gathered, no window goes over a whole run of blocks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "+- Window [" in line or "Window [max(_most" in line]
    return "collect_list" not in plan and any("_part" in line for line in over)


def test_long_range_lists_are_dealt(spark):
    ranges, df = _long_list(spark)
    out = L.in_ranges(df, "run", "block", ranges)
    assert _dealt(out)
    want = {r["k"] for r in df.alias("d").join(ranges.alias("r"), F.expr("d.run = r.run AND d.block BETWEEN r.lo AND r.hi")).collect()}
    got = [r["k"] for r in out.collect()]
    assert want and sorted(got) == sorted(want)


def test_long_value_lists_are_dealt(spark):
    ranges, df = _long_list(spark)
    out = L.interval_value(df, "run", "block", {"v": ranges}, -7.0)
    assert _dealt(out) and out.columns == [*df.columns, "v"]
    lists = [tuple(r) for r in ranges.collect()]
    got = out.collect()
    assert len(got) == df.count()
    for k, run, b, v in got:
        last = max([(lo, hi, x) for r, lo, hi, x in lists if r == run and lo <= b], default=None)
        assert v == (last[2] if last and b <= last[1] else -7.0), k


def test_vectors_and_scores_under_variations(spark):
    from eventloom.operators import scoring as M

    jet = lambda pt, score: (float(pt), 0.5, 0.3, 4.0, score, 0.1, pt > 0)
    jets = [jet(40, 0.9), jet(31, 0.8), jet(50, 0.2), jet(60, 0.05), jet(28, 0.5)]
    muons = [(20.0, 0.1, 0.2, 0.1, 1, 0.5), (10.0, -0.1, 1.2, 0.1, 1, 0.4)]
    rows = [(1, False, jets, muons, 0, 1), (2, True, jets, muons, 0, 1), (3, False, jets[:3], muons, 0, 1), (4, False, jets, muons, 0, 5), (5, None, [], [], -1, -1)]
    kinds = "k int, data boolean, jets array<struct<pt:double,eta:double,phi:double,mass:double,score:double,s:double,fit:boolean>>, muons array<struct<pt:double,eta:double,phi:double,mass:double,charge:int,v:double>>, lead_idx int, sublead_idx int"
    fields = {f: "v" for f in X.MUON_FIELDS}
    variations = X.jet_variations(["s"], muon_scale=("v", "v"))
    assert [v.name for v in variations] == ["nominal", "s_up", "s_down", "MuonRoch_scale_up", "MuonRoch_scale_down"]
    df = spark.createDataFrame(rows, kinds)
    out = X.varied_vectors(df, variations, is_data=F.col("data"), scale_mass=True, muon_fields=fields)
    got = {r["k"]: [None if v is None else dict(zip(X.FEATURES, v)) for v in r["vectors"]] for r in out.collect()}
    plain = X.extract_features(df.where("k = 1").withColumn("jets", F.transform("jets", lambda j: j.withField("good", j["pt"] > 30))), ["k"], muon_fields=fields).first()
    assert got[1][0] == {f: plain[f] for f in X.FEATURES}
    # up: five good jets; down: two of them fall below the cut
    assert got[1][1]["nGoodJet"] == 5 and got[1][1]["sumjet_pt"] == pytest.approx(1.1 * 209) and got[1][1]["jet1_mass"] == pytest.approx(4.4)
    assert got[1][2] is None and got[1][3]["nGoodJet"] == 4 and got[1][3]["lead_mu_px"] == pytest.approx(0.5 * math.cos(0.2))
    assert [len(v) for v in got.values()] == [5, 1, 5, 5, 5] and got[2] == got[1][:1] and {str(v) for k in (3, 4, 5) for v in got[k]} == {"None"}
    layers = [([[0.01] * 61, [-0.01] * 61], [0.0, 0.1])]
    scores = {r["k"]: r["scores"] for r in M.scores_by_variation(out, "vectors", layers, [v.name for v in variations]).collect()}
    z = sum(plain[f] for f in X.FEATURES)
    assert scores[1]["nominal"][0] == pytest.approx(1 / (1 + math.exp(-0.02 * z + 0.1))) and scores[1]["s_down"] is None and list(scores[2]) == ["nominal"]
    assert M.scores_by_variation(out.where("false"), "vectors", layers, [v.name for v in variations]).collect() == []


def test_cells_of_rows(spark):
    """Rows find the same cells as objects inside a collection, without a walk over the
    edges, and a table of bounded size does not move the objects."""
    from eventloom.operators import lookup as L
    from eventloom.plans import correcting as P

    xs = [None, math.nan, math.inf, -math.inf, -0.0, 0.0, -1e-300, 0.05, 0.1, 129.95, 130.0, 500.0, -2.4, -2.32, 1.0]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate((x, y) for x in xs for y in xs)], "k int, x double, y double")
    edges = (-3.0, -2.32, 0.0, 0.05, 0.1, 130.0, 200.0)
    table = L.StoredTable([("x", edges), ("y", tuple(k * 0.05 for k in range(2601)))], spark.range(1).selectExpr("id AS cell", "0D AS value"))
    rows = L._with_cell(df.withColumn("want", table.cell(F.col("x"), F.col("y")).cast("long")), table, [F.col("x"), F.col("y")])
    assert rows.columns == [*df.columns, "want", "_cell"] and rows.where("NOT want <=> _cell").count() == 0 and rows.where("_cell IS NULL").count() == len(xs)
    plan = P.jet_energy_fine(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "aggregate(" not in plan


def test_tables_inside_and_beside_the_plan(spark, monkeypatch):
    """Corrections give the same objects whether their tables fit into the plan or not."""
    from eventloom.operators import corrections as C
    from eventloom.plans import correcting as P

    rows = [(1, 1996, [(30.0, 0.5, 0.1, 4.0, 0.05), (12.0, -2.3, 3.0, 2.0, 0.0)], [(0.5, 0.2)]), (2, 1900, [(80.0, 1.1, -3.0, 9.0, 0.1)], []), (3, 1994, [], []), (4, 1994, None, [])]
    kinds = "k int, run int, jets array<struct<pt:double,eta:double,phi:double,mass:double,raw:double>>, muons array<struct<eta:double,phi:double>>"
    df = spark.createDataFrame(rows, kinds).withColumn("more", F.lit("x"))
    names = ["jet_scale_data", "jet_scale_sources"]
    tables = {"l2": P.L2, "residual": P.RESIDUAL, "scale_sources": P.SCALE_SOURCES}
    options = {"jet_scale_sources": {"sources": P.SOURCES}}
    run = lambda t, **more: C.apply_corrections(df, names, C.Context(tables=t, options=options, **more))
    inside = run(tables)
    beside = run({n: L.stored(spark, t) for n, t in tables.items()}, key=["k"])
    key = lambda r: r["k"]
    assert beside.columns == inside.columns == df.columns
    want = sorted(inside.where("k < 4").collect(), key=key)
    assert sorted(beside.where("k < 4").collect(), key=key) == want and want[1]["jets"][0]["residual"] is None and want[0]["jets"][1]["l2"] is not None
    assert run({n: L.stored(spark, t) for n, t in tables.items()}, key=["k"]).where("k = 4").first()["jets"] == []
    # a table that only grew beyond the limit needs no other call
    monkeypatch.setattr(L, "INLINE_CELLS", 4)
    assert sorted(run(tables, key=["k"]).where("k < 4").collect(), key=key) == want
    with pytest.raises(ValueError, match="key"):
        run(tables)
    assert beside.where("false").collect() == []


def test_count_up_to(spark):
    edges = [0.5 * k for k in range(200)]
    table = L.BinnedTable([("x", [-1.0, *edges, 1e9])], list(range(201)))
    values = [None, -5.0, -0.1, 0.0, 0.49, 0.5, 50.2, 99.5, 1e12, float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    got = [r["b"] for r in df.select("k", table.bin_no(0, F.col("x")).alias("b")).orderBy("k").collect()]
    assert got == [None, 0, 0, 1, 1, 2, 101, 200, 200, 200]


def test_often_asked_blocks_of_long_lists(spark):
    """Rows are dealt once, with the ranges: none are gathered to distinct blocks and joined
    again, and a block of a third of the rows is not put in order."""
    ranges = spark.range(3000).selectExpr("cast(id % 2 as int) run", "id * 4 lo", "id * 4 + id % 5 hi", "cast(id as double) value")
    ranges = ranges.unionAll(spark.createDataFrame([(0, 4000, 4001, -1.0), (0, 4000, 4002, -2.0), (0, 4000, None, -3.0), (1, None, 9, -4.0), (None, 1, 9, -5.0)], "run int, lo long, hi long, value double"))
    blocks = [4000] * 400 + [4002] * 300 + [11996] * 100 + [None] * 50 + list(range(-3, 12100, 29))
    rows = [(k, None if k % 97 == 0 else k % 3, b) for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "k int, run int, block long")
    lists = [tuple(r) for r in ranges.collect()]
    out = L.interval_value(df, "run", "block", {"v": ranges}, -7.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_alone" in plan and plan.count("Aggregate [") == 0
    got = {r["k"]: r["v"] for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for k, run, b in rows:
        begun = [(lo, -1 if hi is None else hi, v) for r, lo, hi, v in lists if None not in (b, run, lo) and r == run and lo <= b]
        last = max(begun, default=None)
        assert got[k] == (last[2] if last and b <= last[1] else -7.0), (k, run, b)
    inside = {k for k, run, b in rows if any(None not in (b, run, lo, hi) and r == run and lo <= b <= hi for r, lo, hi, _ in lists)}
    kept = [r["k"] for r in L.in_ranges(df, "run", "block", ranges).collect()]
    assert inside and sorted(kept) == sorted(inside)


def test_batches_of_varied_vectors_agree_with_rows(spark, monkeypatch):
    """Vectors of a batch are those made row by row, odd numbers and missing objects included."""
    import random

    rnd = random.Random(5)
    odd = [None, math.nan, math.inf, 0.0]
    num = lambda x: rnd.choice(odd) if rnd.random() < 0.01 else x
    jet = lambda: (num(rnd.uniform(5, 90)), num(rnd.uniform(-3, 3)), num(rnd.uniform(-9, 9)), num(rnd.uniform(0, 9)), num(rnd.randint(0, 5) / 5), num(rnd.uniform(0, 0.3)), rnd.choice([True, True, True, False, None]))
    muon = lambda: None if rnd.random() < 0.03 else (num(rnd.uniform(5, 90)), num(rnd.uniform(-3, 3)), rnd.uniform(-9, 9), 0.1, 1, num(rnd.uniform(0, 1)))
    rows = [(k, rnd.choice([True, False, False, None]), None if k % 50 == 0 else [jet() for _ in range(rnd.randint(0, 9))], [muon() for _ in range(rnd.randint(0, 3))], 0, rnd.choice([1, 1, 1, 2, -1, None])) for k in range(400)]
    kinds = "k int, data boolean, jets array<struct<pt:double,eta:double,phi:double,mass:double,score:double,s:double,fit:boolean>>, muons array<struct<pt:double,eta:double,phi:double,mass:double,charge:int,v:double>>, lead_idx int, sublead_idx int"
    variations = X.jet_variations(["s"], muon_scale=("v", "v"))
    df = spark.createDataFrame(rows, kinds).repartition(3)

    def run(**more):
        out = X.varied_vectors(df, variations, is_data=F.col("data"), jet_pt=20.0, muon_fields={f: "v" for f in X.MUON_FIELDS}, **more)
        assert out.columns == [*df.columns, "vectors"]
        return {r["k"]: r["vectors"] for r in out.collect()}

    for more in ({}, {"scale_mass": True, "tagged": lambda j: j["pt"] > 40}):
        got = run(**more)
        with monkeypatch.context() as m:
            m.setattr(X, "_vectors_of_batch", lambda *_: lambda *_: F.lit(None).cast("array<array<double>>"))
            want = run(**more)
        assert len(got) == 400 and sum(v is not None for vs in want.values() for v in vs) > 100
        for k, vs in want.items():
            assert len(vs) == len(got[k])
            for a, b in zip(vs, got[k]):
                assert str(a) == str(b) or a == pytest.approx(b, rel=1e-12, abs=1e-9, nan_ok=True), k


def test_batches_make_the_vectors(spark):
    """Features under variations are not walked through row by row."""
    from eventloom.plans import extracting as P

    plan = P.scores_under_variations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_scores_in_the_batch_that_makes_the_vectors(spark):
    """Handed to the vectors, a network gives the scores it gives on their column, for odd
    rows too, and the vectors stay out of the rows."""
    import random
    from functools import partial

    from eventloom.operators import scoring as M
    from eventloom.plans import extracting as P

    rnd = random.Random(11)
    num = lambda x: rnd.choice([None, math.nan, math.inf, 0.0]) if rnd.random() < 0.02 else x
    obj = lambda: None if rnd.random() < 0.01 else (num(rnd.uniform(5, 90)), num(rnd.uniform(-3, 3)), rnd.uniform(-3, 3), num(rnd.uniform(0, 9)), num(rnd.randint(0, 5) / 5), num(rnd.uniform(0, 0.3)))
    rows = [(k, rnd.choice([True, False, None]), None if k % 50 == 0 else [obj() for _ in range(rnd.randint(0, 8))], 0, rnd.choice([1, 1, 1, 6, -1, None])) for k in range(1200)]
    df = spark.createDataFrame(rows, "k int, data boolean, obj array<struct<pt:double,eta:double,phi:double,mass:double,score:double,v:double>>, lead_idx int, sublead_idx int").repartition(2)
    as_jet = lambda o: F.struct(*[o[c].alias(c) for c in ("pt", "eta", "phi", "mass", "score")], (o["v"] * 0.5).alias("s"), (F.abs(o["eta"]) < 2.5).alias("fit"))
    variations = X.jet_variations(["s"], muon_scale=("v", "v"))
    options = {"is_data": F.col("data"), "jets": "obj", "muons": "obj", "jet_pt": 20.0, "scale_mass": True, "muon_fields": {f: "v" for f in X.MUON_FIELDS}}
    layers, names = [([[0.001 * i for i in range(61)], [-0.002] * 61], [0.0, 0.1])], [v.name for v in variations]
    plain = X.varied_vectors(df.withColumn("jets", F.transform("obj", lambda o: F.when(o.isNotNull(), as_jet(o)))), variations, **options | {"jets": "jets"})
    want = {r["k"]: r["scores"] for r in M.scores_by_variation(plain, "vectors", layers, names).collect()}
    made = M.scores_by_variation(df, partial(X.varied_vectors, variations=variations, as_jet=as_jet, **options), layers, names)
    got = {r["k"]: r["scores"] for r in made.collect()}
    assert made.columns == [*df.columns, "scores"] and len(got) == len(rows) and sum(p is not None for r in want.values() for p in r.values()) > 300
    walked = plain.where("exists(vectors, v -> exists(v, x -> isnull(x) OR isnan(x) OR abs(x) = double('inf')))").count()
    assert walked > 5
    for k, scores in want.items():
        assert list(got[k]) == list(scores), k
        for name, p in scores.items():
            assert str(p) == str(got[k][name]) or got[k][name] == pytest.approx(p, rel=1e-12, nan_ok=True), (k, name)
    plan = P.scores_under_variations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "score(vectors(" in plan and plan.count("vectors(") == 1
    # a tag that no variation moves is made once
    o = F.col("o")
    assert not X._reads_any(lambda j: j["score"] > 0.1, o, {"pt", "mass"})
    assert X._reads_any(lambda j: j["score"] > j["pt"], o, {"pt", "mass"}) and X._reads_any(lambda j: F.size(F.array(j)) > 0, o, {"pt"})


def test_batches_of_tag_weights_agree_with_rows(spark, monkeypatch):
    """Tag weights of a batch are those of the walk through each row, odd jets included."""
    import random

    from eventloom.operators import corrections as C
    from eventloom.plans import correcting as P

    rnd = random.Random(7)
    num = lambda x: rnd.choice([None, math.nan, math.inf]) if rnd.random() < 0.01 else x
    jet = lambda: (num(rnd.uniform(-3, 3)), num(rnd.uniform(10, 200)), num(rnd.uniform(0, 1)), rnd.choice([0, 4, 5, 5, 4, 5, 0, 4, 5, 7, None]) if rnd.random() < 0.1 else rnd.choice([0, 4, 5]), rnd.choice([True, True, False, None]))
    rows = [(k, None if k % 40 == 0 else [jet() for _ in range(rnd.randint(0, 7))]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, jets array<struct<eta:double,pt_jec:double,score:double,flavour:int,good:boolean>>").repartition(3)
    ctx = C.Context(tables={"btag_sf": P.MANY_TAG_SF, "btag_eff": P.BTAG_EFF}, options={"btag_working_point": {"points": P.WPS, "sources": P.MANY_TAG_SOURCES}})

    def run():
        out = C.apply_corrections(df, ["btag_working_point"], ctx)
        return out.columns, {r["k"]: r for r in out.collect()}, out.select("btag_weight")

    columns, got, weight = run()
    assert "ArrowEvalPython" in weight._jdf.queryExecution().optimizedPlan().toString()
    with monkeypatch.context() as m:
        m.setattr(C, "_tag_products", lambda *_: lambda *_: F.lit(None).cast("array<double>"))
        plain_columns, want, _ = run()
    assert columns == plain_columns and len(got) == 300 and sum(r["btag_weight"] not in (None, 1.0) for r in want.values()) > 100
    for k, r in want.items():
        for c in columns[2:]:
            assert got[k][c] == r[c] or str(got[k][c]) == str(r[c]) or got[k][c] == pytest.approx(r[c], rel=1e-12, nan_ok=True), (k, c)
        assert str(got[k]["jets"]) == str(r["jets"])
