"""Transfer-factor fits on histograms.

Sums run on Spark; only k x k systems (k = number of regions) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.binning import Axis


def residual(hists: DataFrame, keys: Sequence[str], data: Column, removed: Column, process: str = "process", scales: dict[str, float] | None = None) -> DataFrame:
    """Data minus the removed processes, each with its own scale."""
    f = None
    for p, v in (scales or {}).items():
        cond = F.col(process) == p
        f = F.when(cond, F.lit(float(v))) if f is None else f.when(cond, F.lit(float(v)))
    f = F.lit(1.0) if f is None else f.otherwise(F.lit(1.0))
    sign = F.when(data, 1.0).when(removed, -1.0)
    rows = hists.filter(data | removed).select(
        *keys, (F.col("sumw") * f * sign).alias("sumw"), (F.col("sumw2") * f * f).alias("sumw2")
    )
    return rows.groupBy(*keys).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))


def components(hists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Integral, negative bins and bins per component, for diagnostics."""
    return hists.groupBy(*keys).agg(
        F.sum("sumw").alias("integral"), F.count(F.lit(1)).alias("bins"), F.count_if(F.col("sumw") < 0).alias("negative_bins")
    )


def cell(ix: Column, iy: Column, nx: int) -> Column:
    """Cell number of a two-dimensional region."""
    return iy * nx + ix


def by_region(wide: DataFrame, axis: Axis, regions: Axis, y_axis: Axis | None = None, y_regions: Axis | None = None) -> DataFrame:
    """Sum fine bins into regions by bin centre (last edge inclusive).

    ``wide`` has one row per bin with sr, sr2, anti, anti2, tight, tight2.
    """
    region = regions.region(axis.center(F.col("ix")))
    if y_axis is not None:
        region = cell(region, y_regions.region(y_axis.center(F.col("iy"))), regions.n)
    names = ["sr", "sr2", "anti", "anti2", "tight", "tight2"]
    return (
        wide.withColumn("region", region)
        .filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def region_shares(regions: DataFrame) -> DataFrame:
    """Share of each region in the total yield of the anti sample. One row per
    region, so the window is bounded by the region list."""
    w = Window.partitionBy(F.lit(0))
    return regions.withColumn("share", F.col("anti") / F.sum("anti").over(w))


def share_list(regions: DataFrame, k: int) -> list[float]:
    """Share of each of the ``k`` regions by its number; a region without rows has none."""
    found = {r["region"]: r["share"] for r in regions.select("region", "share").collect()}
    return [float(found.get(i) or 0.0) for i in range(k)]


def sigma(sr: Column, sr2: Column) -> Column:
    """Error of a bin: root of its squared weights, else of its content, else 1."""
    return F.when(sr2 > 0, F.sqrt(sr2)).when(sr > 0, F.sqrt(F.abs(sr))).otherwise(F.lit(1.0))


def normal_sums(rows: DataFrame, k: int) -> DataFrame:
    """Normal matrix and right-hand side as one row of sums.

    ``rows`` has r0..r(k-1), value and sigma. Partial sums are made in every
    task; the result has k * (k + 3) / 2 numbers whatever the input size.
    """
    w = F.when(F.col("sigma") > 0, 1.0 / (F.col("sigma") * F.col("sigma"))).otherwise(F.lit(1.0))
    aggs = [F.sum(w * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(w * F.col(f"r{i}") * F.col("value")).alias(f"b{i}") for i in range(k)]
    return rows.agg(*aggs)


@dataclass(frozen=True)
class Solution:
    params: list[float]
    errors: list[float]
    covariance: list[list[float]]

    def mean(self, shares: Sequence[float]) -> tuple[float, float]:
        """Share-weighted mean of the parameters and its error."""
        s = np.asarray(shares)
        var = float(s @ np.asarray(self.covariance) @ s)
        return float(s @ np.asarray(self.params)), float(np.sqrt(max(var, 0.0)))


def solve(rows: DataFrame, k: int) -> Solution:
    """Weighted least squares; a singular system is an error."""
    sums = normal_sums(rows, k).first().asDict()
    m = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    b = np.array([sums[f"b{i}"] for i in range(k)], dtype=float)
    if np.linalg.matrix_rank(m) < k:
        raise ValueError("singular normal matrix")
    cov = np.linalg.inv(m)
    return Solution(list(map(float, cov @ b)), list(map(float, np.sqrt(np.maximum(np.diag(cov), 0.0)))), cov.tolist())


def region_rows(regions: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Equations of the fit: value = sr, row = tight * shares with anti added on
    the own region. ``regions`` has one row per equation: a region, or a fine bin
    with the number of its region."""
    k = len(shares)
    cols = {
        f"r{i}": F.col("tight") * F.lit(float(shares[i])) + F.when(F.col("region") == i, F.col("anti")).otherwise(F.lit(0.0))
        for i in range(k)
    }
    return regions.withColumns({**cols, "value": F.col("sr"), "sigma": sigma(F.col("sr"), F.col("sr2"))})


def predict(wide: DataFrame, region: Column, params: Sequence[float], mean: float) -> DataFrame:
    """Prediction, pull and ratio per fine bin."""
    own = F.coalesce(F.get(F.lit([float(p) for p in params]), region), F.lit(0.0))
    pred = own * F.col("anti") + F.lit(mean) * F.col("tight")
    s = sigma(F.col("sr"), F.col("sr2"))
    out = wide.withColumns({"prediction": pred, "sigma": s})
    return out.withColumns(
        {
            "pull": (F.col("sr") - F.col("prediction")) / F.col("sigma"),
            "ratio": F.when(F.col("prediction") != 0, F.col("sr") / F.col("prediction")).otherwise(F.lit(0.0)),
        }
    )


def goodness(rows: DataFrame, params: Sequence[float]) -> DataFrame:
    """chi2, degrees of freedom and their quotient of the equations that were fitted
    (``r0.., value, sigma`` of ``region_rows``)."""
    fitted = sum((F.col(f"r{i}") * F.lit(float(p)) for i, p in enumerate(params)), F.lit(0.0))
    pull = (F.col("value") - fitted) / F.col("sigma")
    out = rows.agg(F.coalesce(F.sum(pull * pull), F.lit(0.0)).alias("chi2"), (F.count(F.lit(1)) - len(params)).alias("ndof"))
    return out.withColumn("chi2_ndof", F.when(F.col("ndof") > 0, F.col("chi2") / F.col("ndof")).otherwise(F.lit(0.0)))


def rate_uncertainty(direct: dict[str, list[float]], parts: dict[str, Sequence[str]], processes: Sequence[str], default: list[float] | None = None) -> dict[str, list[float]]:
    """Normalisation uncertainty per process (configuration): its own entry, else
    the entry shared by all its components, else the default."""
    out = {}
    for p in processes:
        if p in direct:
            out[p] = list(direct[p])
            continue
        found = [tuple(direct[c]) for c in parts.get(p, ()) if c in direct]
        if len(set(found)) > 1:
            raise ValueError(f"components of {p} disagree")
        if found and len(found) == len(parts[p]):
            out[p] = list(found[0])
        elif default is not None:
            out[p] = list(default)
        else:
            raise ValueError(f"no uncertainty for {p}")
    return out
