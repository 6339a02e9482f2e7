"""Every registered query against its SQL; those without SQL against brute force."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare
from eventloom.plans import load_all
from eventloom.plans.registry import QUERIES, SQL

load_all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, con, sf):
    err, rows = compare(spark, con, QUERIES[name], SQL[name], sf)
    assert err is None, err
    assert rows > 0


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(QUERIES) - set(SQL) == {"trained_classifier"}
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_do_not_depend_on_partitioning(spark, sf):
    """Keyed randomness and ranks give the same rows on another partitioning."""
    for name in ("stratified_split", "permutation_importance", "mix_ranking"):
        before = sorted(map(str, QUERIES[name](spark, sf).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            after = sorted(map(str, QUERIES[name](spark, sf).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert before == after, name


def scan_by_hand(rows, scans):
    """rows: (score, s, b); best significance over evenly spread ranks."""
    rows = sorted(rows, reverse=True)
    n = len(rows)
    c = min(max(1, scans), n)
    ranks = sorted({math.floor(k * (n - 1) / (c - 1)) if c > 1 else 0 for k in range(c)})
    best = 0.0
    for r in ranks:
        cut = rows[r][0]
        s = sum(x[1] for x in rows if x[0] >= cut)
        b = sum(x[2] for x in rows if x[0] >= cut)
        if s > 0 and b > 0:
            best = max(best, math.sqrt(2 * ((s + b) * math.log1p(s / b) - s)))
    return best


def test_mix_comparison(spark, sf):
    from eventloom.operators.optimise import simplex_grid
    from eventloom.plans.optimising import scored

    rows = [tuple(r) for r in scored(spark, sf).select("s0", "s1", "s2", "sig", "bkg").collect()]

    def mixed(w):
        return scan_by_hand([(a / (0.0 + w[0] * b + w[1] * c + 1e-6), s, g) for a, b, c, s, g in rows], 20)

    from eventloom.operators import optimise as O

    df = scored(spark, sf)
    got = {tuple(r["weights"]): r["significance"] for r in O.rank_mixes(df, ["s0", "s1", "s2"], "sig", "bkg", simplex_grid(0.5, 2), 20, bound=False).collect()}
    assert got.keys() == {(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)}
    for w, z in got.items():
        assert z == pytest.approx(mixed(w), rel=1e-9)
    kinds = {r["kind"]: r["significance"] for r in QUERIES["mix_comparison"](spark, sf).collect()}
    assert kinds["best"] >= kinds["uniform"] > 0


def fit_by_hand(spark, sf):
    import numpy as np

    from eventloom.plans.combining import fit_bins

    bins = sorted(fit_bins(spark, sf).collect(), key=lambda r: r["ix"])
    region = lambda r: 0 if 5 * r["ix"] - 2.5 < 30 else 1 if 5 * r["ix"] - 2.5 < 60 else 2
    sums = {k: [sum(r[k] for r in bins if region(r) == i) for i in range(3)] for k in ("sr", "sr2", "anti", "tight")}
    share = np.array(sums["anti"]) / sum(sums["anti"])
    rows = np.outer(sums["tight"], share) + np.diag(sums["anti"])
    weight = 1 / np.array(sums["sr2"])
    normal = rows.T @ (weight[:, None] * rows)
    cov = np.linalg.inv(normal)
    params = cov @ (rows.T @ (weight * np.array(sums["sr"])))
    mean = float(share @ params)
    return bins, region, params, mean, float(np.sqrt(share @ cov @ share))


def test_region_fit_by_hand(spark, sf):
    bins, region, params, mean, err = fit_by_hand(spark, sf)
    from eventloom.plans.combining import _fit

    _, _, shares, rows, sol = _fit(spark, sf, "region")
    assert sol.params == pytest.approx(params.tolist(), rel=1e-6)
    assert sol.mean(shares) == (pytest.approx(mean, rel=1e-6), pytest.approx(err, rel=1e-6))
    from eventloom.operators import fit as T

    quality = T.goodness(rows, sol.params).first()
    assert quality["chi2"] == pytest.approx(0.0, abs=1e-6) and (quality["ndof"], quality["chi2_ndof"]) == (0, 0.0)


def test_overlap_first_rule(spark, sf):
    from eventloom.plans.correcting import gen_events

    def sources(gen, jets):
        b = [((abs(g["pdg"]) // 100) % 10 == 5 or (abs(g["pdg"]) // 1000) % 10 == 5) and abs(g["pdg"]) >= 500 and (g["flags"] >> 13) & 1 == 1 for g in gen]
        taken = {g["mother"] for i, g in enumerate(gen) if b[i] and g["mother"] >= 0}
        origin = [0] * len(gen)
        for i, g in enumerate(gen):
            if not b[i] or i in taken:
                continue
            at, src = i, -2
            for _ in range(10):
                if not 0 <= at < len(gen):
                    break
                if abs(gen[at]["pdg"]) in (6, 23, 24, 25):
                    src = abs(gen[at]["pdg"])
                    break
                at = gen[at]["mother"]
            origin[i] = src
        out = []
        for j in jets:
            best, hit = 0.4, -1
            for i, g in enumerate(gen):
                if origin[i] == 0:
                    continue
                dphi = abs(g["phi"] - j["phi"])
                dphi = 2 * math.pi - dphi if dphi > math.pi else dphi
                dr = math.hypot(g["eta"] - j["eta"], dphi)
                if dr < best:
                    best, hit = dr, origin[i]
            out.append(hit if j["hadron_flavour"] == 5 else -1)
        return out

    want = {}
    for r in gen_events(spark, sf).collect():
        n = sum(1 for s in sources(r["gen"], r["genjets"]) if s not in (6, -1))
        if n < 2:
            want[r["k"]] = n
    got = {r["k"]: r["n_additional"] for r in QUERIES["overlap_first_rule"](spark, sf).collect()}
    assert got == want


def test_trained_classifier(spark, sf):
    """Every row is predicted, and the gradient of the likelihood is zero at the fit."""
    import numpy as np

    from eventloom.operators import scoring as M
    from eventloom.plans.extracting import labelled_vectors

    df, names = labelled_vectors(spark, sf)
    assert QUERIES["trained_classifier"](spark, sf).agg(F.sum("n")).first()[0] == df.count()
    model = M.train_multinomial(df, names, "label", "w", max_iter=300, reg=0.0).stages[-1]
    rows = np.array([[r[n] for n in [*names, "label", "w"]] for r in df.collect()])
    x, label, w = rows[:, :-2], rows[:, -2].astype(int), rows[:, -1]
    z = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(p)), label] -= 1
    assert np.abs((w[:, None] * p).T @ x / w.sum()).max() < 2e-3
