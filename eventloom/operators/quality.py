"""Reports, scores and checks on flat tables."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis


def dataset_report(df: DataFrame, weight: str, sign: str, label: str, channel: str) -> DataFrame:
    """Events, sum of w and |w| in total, per sign, per label, per channel, from
    one grouping-sets aggregation. ``part`` names the grouping."""
    cols = [F.col(c) for c in (sign, label, channel)]
    sets = df.groupingSets([[], *[[c] for c in cols]], *cols).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n_events"), F.sum(weight).alias("weight_sum"), F.sum(F.abs(F.col(weight))).alias("abs_weight_sum")
    )
    part = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "sign").when(F.col("g") == 5, "label").otherwise("channel")
    value = F.when(F.col("g") == 3, F.col(sign).cast("string")).when(F.col("g") == 5, F.col(label).cast("string")).when(
        F.col("g") == 6, F.col(channel).cast("string")
    )
    return sets.select(part.alias("part"), value.alias("value"), "n_events", "weight_sum", "abs_weight_sum")


def accuracy(df: DataFrame, truth: str, pred: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted accuracy with |w|, the plain one where the weights sum to 0."""
    hit = F.col(truth) == F.col(pred)
    w = F.abs(F.col(weight))
    out = df.groupBy(*keys).agg(
        F.sum(F.when(hit, w).otherwise(F.lit(0.0))).alias("_h"),
        F.sum(w).alias("_t"),
        F.avg(hit.cast("double")).alias("unweighted"),
    )
    return out.withColumn("accuracy", F.when(F.col("_t") > 0, F.col("_h") / F.col("_t")).otherwise(F.col("unweighted"))).drop("_h", "_t")


def confusion(df: DataFrame, truth: str, pred: str, n: int) -> DataFrame:
    """Confusion matrix as rows, normalised per true class; labels outside
    0..n-1 do not count."""
    from eventloom.operators.scale import attach_totals

    ok = F.col(truth).between(0, n - 1) & F.col(pred).between(0, n - 1)
    cells = df.filter(ok).groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    rows = attach_totals(cells, [truth], _t=F.sum("n"))
    return rows.withColumn("fraction", F.col("n") / F.col("_t")).drop("_t")


def covariance(df: DataFrame, features: Sequence[str], weight: str) -> DataFrame:
    """Weighted means, covariances and correlations of all feature pairs: all
    sums in one aggregation, one output row per pair (a <= b)."""
    k = len(features)
    w = F.col(weight)
    aggs = [F.sum(w).alias("_w")] + [F.sum(w * F.col(f)).alias(f"_x{i}") for i, f in enumerate(features)]
    aggs += [
        F.sum(w * F.col(features[i]) * F.col(features[j])).alias(f"_x{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    sums = df.agg(*aggs)

    def mean(i: int) -> Column:
        return F.col(f"_x{i}") / F.col("_w")

    def cov(i: int, j: int) -> Column:
        return F.col(f"_x{min(i, j)}_{max(i, j)}") / F.col("_w") - mean(i) * mean(j)

    def corr(i: int, j: int) -> Column:
        vi, vj = cov(i, i), cov(j, j)
        r = cov(i, j) / F.sqrt(vi * vj)
        return F.when((vi > 0) & (vj > 0), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))

    rows = F.array(
        *[
            F.struct(
                F.lit(features[i]).alias("a"),
                F.lit(features[j]).alias("b"),
                mean(i).alias("mean_a"),
                mean(j).alias("mean_b"),
                cov(i, j).alias("covariance"),
                corr(i, j).alias("correlation"),
            )
            for i in range(k)
            for j in range(i, k)
        ]
    )
    return sums.select(F.inline(rows))


def score_means(df: DataFrame, keys: Sequence[str], scores: Sequence[str], weight: str) -> DataFrame:
    """Mean of every score field per group, weighted with a plain fallback; one
    aggregation over all fields."""
    aggs = [F.sum(weight).alias("_w")]
    for s in scores:
        aggs += [F.sum(F.col(s) * F.col(weight)).alias(f"_s_{s}"), F.avg(s).alias(f"_m_{s}")]
    out = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("score"),
                F.when(F.col("_w") > 0, F.col(f"_s_{s}") / F.col("_w")).otherwise(F.col(f"_m_{s}")).alias("mean"),
            )
            for s in scores
        ]
    )
    return out.select(*keys, F.inline(rows))


def relabel(df: DataFrame, label: str, keep: Sequence) -> DataFrame:
    """Keep the chosen labels and number them 0..k-1 in the given order."""
    new = None
    for i, k in enumerate(keep):
        new = F.when(F.col(label) == F.lit(k), i) if new is None else new.when(F.col(label) == F.lit(k), i)
    return df.withColumn(label, new).filter(F.col(label).isNotNull())


def check_contract(df: DataFrame, required: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """Violations per rule as a table; a missing column raises right away."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, ok in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(rules)])
    return counts.select(F.inline(rows))


def feature_histograms(df: DataFrame, axes: Sequence[Axis], groups: Sequence[str], weight: Column, per_group: bool = True) -> DataFrame:
    """Histograms of many features by group, values outside clipped into the
    outer bins, scaled to unit sum per histogram (or per feature)."""
    from eventloom.operators.scale import attach_totals

    entries = F.array(*[F.struct(F.lit(a.var).alias("feature"), a.clamped_index(F.col(a.var)).alias("ix")) for a in axes])
    rows = df.select(*groups, weight.cast("double").alias("_w"), F.inline(entries)).dropna(subset=["ix"])
    hist = rows.groupBy("feature", *groups, "ix").agg(
        F.sum("_w").alias("sumw"), F.sum(F.col("_w") * F.col("_w")).alias("sumw2"), F.count(F.lit(1)).alias("n")
    )
    hist = attach_totals(hist, ["feature", *groups] if per_group else ["feature"], _t=F.sum("sumw"))
    ok = F.col("_t") > 0
    return hist.select(
        "feature",
        *groups,
        "ix",
        F.when(ok, F.col("sumw") / F.col("_t")).otherwise(F.col("sumw")).alias("content"),
        F.when(ok, F.sqrt("sumw2") / F.col("_t")).otherwise(F.sqrt("sumw2")).alias("error"),
        "n",
    )


#: fixed values: ranges of the features, by name
FEATURE_RANGES = {
    "jet1_px": (-400.0, 400.0),
    "jet1_py": (-400.0, 400.0),
    "jet1_pz": (-500.0, 500.0),
    "jet1_mass": (0.0, 50.0),
    "jet1_btag": (0.0, 1.0),
    "jet1_dr_mu1": (0.0, 5.0),
    "jet1_dr_mu2": (0.0, 5.0),
    "jet2_px": (-400.0, 400.0),
    "jet2_py": (-400.0, 400.0),
    "jet2_pz": (-500.0, 500.0),
    "jet2_mass": (0.0, 50.0),
    "jet2_btag": (0.0, 1.0),
    "jet2_dr_mu1": (0.0, 5.0),
    "jet2_dr_mu2": (0.0, 5.0),
    "jet3_px": (-400.0, 400.0),
    "jet3_py": (-400.0, 400.0),
    "jet3_pz": (-500.0, 500.0),
    "jet3_mass": (0.0, 50.0),
    "jet3_btag": (0.0, 1.0),
    "jet3_dr_mu1": (0.0, 5.0),
    "jet3_dr_mu2": (0.0, 5.0),
    "jet4_px": (-400.0, 400.0),
    "jet4_py": (-400.0, 400.0),
    "jet4_pz": (-500.0, 500.0),
    "jet4_mass": (0.0, 50.0),
    "jet4_btag": (0.0, 1.0),
    "jet4_dr_mu1": (0.0, 5.0),
    "jet4_dr_mu2": (0.0, 5.0),
    "bjet_dr_01": (0.0, 5.0),
    "bjet_dr_02": (0.0, 5.0),
    "bjet_dr_03": (0.0, 5.0),
    "bjet_dr_12": (0.0, 5.0),
    "bjet_dr_13": (0.0, 5.0),
    "bjet_dr_23": (0.0, 5.0),
    "bjet_m_01": (0.0, 400.0),
    "bjet_m_02": (0.0, 400.0),
    "bjet_m_03": (0.0, 400.0),
    "bjet_m_12": (0.0, 400.0),
    "bjet_m_13": (0.0, 400.0),
    "bjet_m_23": (0.0, 400.0),
    "lead_mu_px": (-400.0, 400.0),
    "lead_mu_py": (-400.0, 400.0),
    "lead_mu_pz": (-500.0, 500.0),
    "sublead_mu_px": (-200.0, 200.0),
    "sublead_mu_py": (-200.0, 200.0),
    "sublead_mu_pz": (-400.0, 400.0),
    "lead_mu_miniPFRelIso_all": (-400.0, 400.0),
    "sublead_mu_miniPFRelIso_all": (-400.0, 400.0),
    "lead_mu_jetRelIso": (-400.0, 400.0),
    "sublead_mu_jetRelIso": (-400.0, 400.0),
    "lead_mu_jetDF": (-400.0, 400.0),
    "sublead_mu_jetDF": (-400.0, 400.0),
    "lead_mu_promptMVA": (-400.0, 400.0),
    "sublead_mu_promptMVA": (-400.0, 400.0),
    "dimuon_dr": (0.0, 5.0),
    "dimuon_mass": (0.0, 400.0),
    "sumjet_pt": (0.0, 1500.0),
    "sumbjet_pt": (0.0, 1000.0),
    "jet_cent": (0.0, 1.0),
}
#: fixed values: first and last edge of counts, in unit bins
FEATURE_COUNTS = {"nGoodJet": (3.5, 10.5), "nBJet": (2.5, 5.5)}
#: fixed values: ranges of other names, the first fitting pattern counts
OTHER_RANGES = (
    ("*dr*", 0.0, 5.0),
    ("*_m_*", 0.0, 400.0),
    ("*btag*", 0.0, 1.0),
    ("sublead_mu_p*_p[xy]", -200.0, 200.0),
    ("sublead_mu_p*_pz", -400.0, 400.0),
    ("lead_mu_p*_pz", -500.0, 500.0),
    ("jet*_pz", -500.0, 500.0),
    ("lead_mu_p*_mass", 0.0, 50.0),
    ("jet*_mass", 0.0, 50.0),
    ("*", -400.0, 400.0),
)


def default_feature_axis(feature: str, n: int = 40) -> Axis:
    """Range of a feature by its name."""
    if feature in FEATURE_COUNTS:
        lo, hi = FEATURE_COUNTS[feature]
        return Axis(feature, round(hi - lo), lo, hi)
    if feature in FEATURE_RANGES:
        return Axis(feature, n, *FEATURE_RANGES[feature])
    lo, hi = next((lo, hi) for pattern, lo, hi in OTHER_RANGES if fnmatchcase(feature, pattern))
    return Axis(feature, n, lo, hi)


def prompt_counts(df: DataFrame, n_true: Column, leading: Column, subleading: Column, weight: Column, scale: float = 1.0, most: int = 3) -> DataFrame:
    """Yields ``kind, category, n, yield`` of one pass over events: by the number of true
    prompt objects (``true``, ``most`` and more together), and by how many of the two
    leading reconstructed ones are prompt (``reco``: 0, 1, 2). Unknown flags are false,
    an unknown number counts as none."""
    known = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    kinds = F.array(
        F.struct(F.lit("true").alias("kind"), F.least(F.coalesce(n_true, F.lit(0)), F.lit(most)).cast("int").alias("category")),
        F.struct(F.lit("reco").alias("kind"), (known(leading) + known(subleading)).alias("category")),
    )
    rows = df.select(weight.cast("double").alias("_w"), F.inline(kinds))
    return rows.groupBy("kind", "category").agg(F.count(F.lit(1)).alias("n"), (F.sum("_w") * scale).alias("yield"))
