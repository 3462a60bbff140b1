"""Distances to a reference set: moments, shrunk covariances, centroids, memory slots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.functions.scoring import distance
from omenlog.operators import moments


def covariance(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Sample covariance (n - 1) in long form ``i, j, cov``."""
    return moments.long_form(moments.co_moments(df, vec))


def mean_vector(df: DataFrame, vec: str = "vec", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean vector per group as an array."""
    dense = df.select(*by, array_to_vector(vec).alias("v"))
    return dense.groupBy(*by).agg(Summarizer.mean(F.col("v")).alias("m")).select(
        *by, vector_to_array("m").alias("mean")
    )


def separation(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Distance of the centroids of labels 0 and 1 against the spread inside them, one row."""
    df = df.filter("label IN (0, 1)")  # so there are two centroids at most
    centres = mean_vector(df, vec, ("label",))
    near = df.join(F.broadcast(centres), "label").groupBy("label").agg(
        F.avg(distance(F.col(vec), F.col("mean"))).alias("spread"), F.first("mean").alias("mean")
    )
    row = near.agg(*[
        F.max(F.when(F.col("label") == side, F.col(c))).alias(f"{c}{side}")
        for side in (0, 1) for c in ("spread", "mean")
    ])
    return row.select(
        distance(F.col("mean0"), F.col("mean1")).alias("inter"),
        F.col("spread0").alias("intra_normal"), F.col("spread1").alias("intra_anomaly"),
    ).withColumn("ratio", F.col("inter") / (F.col("intra_normal") + F.col("intra_anomaly") + 1e-8))


def drift_before_failure(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean distance of pre-failure vectors from the centroid of the normal ones."""
    centre = mean_vector(df.filter("label = 0"), vec).scalar()
    early = df.filter("pre_failure = 1").withColumn("_c", centre)
    return early.agg(
        F.count("*").alias("rows"), F.avg(distance(F.col(vec), F.col("_c"))).alias("drift")
    )


@dataclass(frozen=True)
class Reference:
    """A fitted reference set: optional projection, mean and inverse covariance (all d x d)."""

    mean: np.ndarray
    inverse: np.ndarray
    projection: np.ndarray | None = None
    shrinkage: float = 0.0

    def distance(self, vec: str | Column) -> Column:
        """Mahalanobis distance of a vector column, in Arrow batches."""
        mean, inverse, projection = self.mean, self.inverse, self.projection

        def far(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_numpy()).astype(np.float64)
            gap = x - mean
            if projection is not None:
                gap = gap @ projection
            return pd.Series(np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", gap, inverse, gap))))

        far.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return F.pandas_udf(far, "double")(vec)


def fit(
    df: DataFrame, vec: str = "vec", *, components: int | None = 64, estimator: str = "oas"
) -> Reference:
    """Fit mean and covariance of normal vectors: ``oas``, ``ledoit_wolf`` or ``ridge``.

    The data is read once for the moments (twice for ledoit_wolf, which needs the fourth
    moment of the norm); only d x d numbers come to the driver.
    """
    found = moments.whole(moments.co_moments(df, vec))
    n = found[0] if found else 0
    if n < 10:
        raise ValueError(f"at least 10 rows are needed, got {n}")
    _, mean, scatter = found
    d, cov = len(mean), scatter / n  # population covariance
    projection = None
    if components is not None and components < d:
        values, vectors = np.linalg.eigh(cov)
        projection = vectors[:, np.argsort(values)[::-1][:components]]
        cov = projection.T @ cov @ projection
    p = len(cov)
    level = np.trace(cov) / p
    if estimator == "ridge":
        return Reference(mean, np.linalg.inv(cov + 1e-4 * np.eye(p)), projection)
    if estimator == "oas":
        mean_square = np.mean(cov**2)
        top = mean_square + level**2
        bottom = (n + 1) * (mean_square - level**2 / p)
        weight = 1.0 if bottom == 0 else min(top / bottom, 1.0)
    elif estimator == "ledoit_wolf":
        weight = _ledoit_wolf(df, vec, n, mean, projection, cov, level)
    else:
        raise ValueError(f"unknown estimator: {estimator}")
    mixed = (1 - weight) * cov + weight * level * np.eye(p)
    try:
        inverse = np.linalg.inv(mixed)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(mixed)
    return Reference(mean, inverse, projection, weight)


def _ledoit_wolf(df, vec, n, mean, projection, cov, level) -> float:
    def fourth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                gap = np.stack(pdf[vec].to_numpy()).astype(np.float64) - mean
                if projection is not None:
                    gap = gap @ projection
                total += float((np.einsum("ij,ij->i", gap, gap) ** 2).sum())
        yield pd.DataFrame({"f": [total]})

    f = df.select(vec).mapInPandas(fourth, "f double").agg(F.sum("f")).first()[0]
    p = len(cov)
    delta = float((cov**2).sum()) - p * level**2
    beta = (f / n - float((cov**2).sum())) / n
    return 0.0 if beta <= 0 or delta <= 0 else min(beta, delta) / delta


def soft_retrieval(df: DataFrame, memory: DataFrame, vec: str = "vec") -> DataFrame:
    """Similarity-weighted mean of the memory slots: adds ``retrieved`` and ``weights``.

    ``memory`` (columns ``slot, mean``) is the caller's fixed set of slots; every row gets a
    weight for each of them, so it is as small as one value of the answer.
    """
    rows = memory.select("slot", "mean").collect()
    slots = np.asarray([r["mean"] for r in sorted(rows, key=lambda r: r["slot"])], dtype=np.float64)

    def retrieve(values: pd.Series) -> pd.DataFrame:
        x = np.stack(values.to_numpy()).astype(np.float64)
        logits = x @ slots.T / np.sqrt(slots.shape[1])
        weights = np.exp(logits - logits.max(axis=1, keepdims=True))
        weights /= weights.sum(axis=1, keepdims=True)
        return pd.DataFrame({"retrieved": list(weights @ slots), "weights": list(weights)})

    retrieve.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(retrieve, "retrieved array<double>, weights array<double>")
    return df.withColumn("_r", udf(vec)).select("*", "_r.retrieved", "_r.weights").drop("_r")
