"""Batch scoring of dense networks and model training on weighted tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.corrections import settle

Layer = tuple[Sequence[Sequence[float]], Sequence[float]]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def dense_scores(features: Column, layers: Sequence[Layer]) -> Column:
    """Class probabilities of a feature array: linear layers with ReLU between
    them and a softmax at the end. Arrow batches, one matrix product per layer. A
    missing array, or one with a missing number, has no scores."""
    weights = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        rows = {k: np.asarray(v, dtype=np.float64) for k, v in batch.items() if v is not None}
        rows = {k: v for k, v in rows.items() if not np.isnan(v).any()}
        if not rows:
            return out
        x = np.stack(list(rows.values()))
        for no, (w, b) in enumerate(weights):
            x = x @ w.T + b
            if no < len(weights) - 1:
                x = np.maximum(x, 0.0)
        for k, p in zip(rows, softmax(x)):
            out[k] = p
        return out

    return score(features)


def dense_scores_of_each(vectors: Column, layers: Sequence[Layer]) -> Column:
    """Class probabilities of every vector in an array of feature vectors: all vectors of
    an Arrow batch go through one matrix product per layer. A missing vector, or one with
    a missing number, has no scores; a missing array has none."""
    weights = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]
    width, classes = weights[0][0].shape[1], len(weights[-1][1])

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def score(batch: pa.Array) -> pa.Array:
        each = batch.flatten()
        flat = each.flatten()
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        there = each.is_valid().to_numpy(zero_copy_only=False)
        x = values.reshape(-1, width)
        # no sum is a number if one of its parts is not
        fine = ~np.isnan(x @ np.ones(width))
        if not fine.all():
            fine = ~np.isnan(x).any(axis=1)
            x = x[fine]
        for no, (w, b) in enumerate(weights):
            x = x @ w.T + b
            if no < len(weights) - 1:
                x = np.maximum(x, 0.0)
        scored = np.zeros(len(each), bool)
        scored[np.flatnonzero(there)[fine]] = True
        ends = np.concatenate([[0], np.cumsum(scored) * classes]).astype(np.int32)
        p = softmax(x).ravel() if len(x) else np.empty(0)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(p), mask=pa.array(~scored))
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        outer = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), lists, mask=pc.is_null(batch))

    return score(vectors)


def scores_by_variation(df: DataFrame, vectors: str | Callable[..., DataFrame], layers: Sequence[Layer], names: Sequence[str], out: str = "scores") -> DataFrame:
    """Add ``out``: a map from variation to its class probabilities (null where the
    event fails the selection under it). ``vectors`` is a column, or the step that makes
    it (``varied_vectors`` with its options), which then scores them in its batches."""
    score = lambda each: dense_scores_of_each(each, layers)
    if callable(vectors):
        scored = settle(vectors(df, out=out, use=score), out)
    else:
        # the vectors are made once, before the batches, and not as part of the call
        scored = settle(df, vectors).withColumn(out, score(F.col(vectors)))
    return scored.withColumn(out, F.map_from_arrays(F.slice(F.lit(list(names)), F.lit(1), F.size(out)), F.col(out)))


def with_prediction(df: DataFrame, features: Column, layers: Sequence[Layer], classes: Sequence[str]) -> DataFrame:
    """Add ``scores``, ``predicted`` (first of equal maxima), ``best_score`` and
    ``class_name``."""
    scored = df.withColumn("scores", dense_scores(features, layers))
    best = F.array_max("scores")
    at = (F.array_position("scores", best) - 1).cast("int")
    return scored.withColumns(
        {"predicted": at, "best_score": best, "class_name": F.get(F.lit(list(classes)), at)}
    )


def linear_margin(features: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of feature columns."""
    return sum((f * F.lit(float(w)) for f, w in zip(features, weights)), F.lit(0.0))


def train_multinomial(df: DataFrame, features: Sequence[str], label: str, weight: str, max_iter: int = 20, reg: float = 0.01):
    """Multinomial logistic regression with per-event weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol=label, weightCol=weight, family="multinomial", maxIter=max_iter, regParam=reg
        ),
    ]
    return Pipeline(stages=stages).fit(df)
