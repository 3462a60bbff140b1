"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.llm.common import labelled
from omenlog.llm.linear import Grams, Sparse, log_count_ratios, logistic, placement, sigmoid
from omenlog.session import checkpointed

GRAMS = Grams(sizes=(3, 4, 5))
#: The classifier is fitted on a sample of at most about so many labelled documents.
FIT_ROWS = 8_192
FEATURES = 1 << 13


@dataclass(frozen=True)
class Model:
    """The weight of each feature bucket and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, text: Column) -> Column:
        """The probability of label 1 for each text."""
        model = self

        def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            place = placement(model.buckets)
            for texts in batches:
                z = [model.weights[GRAMS.columns(t, place)].sum() for t in texts]
                yield pd.Series(sigmoid(np.array(z, dtype=float) + model.intercept))

        return F.pandas_udf(each, "double")(text)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from the fit; a null id is never learned from or held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", fit_rows: int = FIT_ROWS,
    features: int = FEATURES, l2: float = 1.0,
) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out.

    Both classes are drawn (up to half the sample each) and weighted back to their true shares.
    The presence of each n-gram counts, times its log-count ratio.  Without labels of both classes
    the model is the constant share of label 1 (0 without any).
    """
    learn = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    sample = labelled(docs.select("doc_id", "text"), labels, label, fit_rows, keep=learn)
    sample = checkpointed(sample.select("text", "_y", "_rate").repartition(8))
    seen = sample.groupBy("_y").agg(F.sum(1 / F.col("_rate")).alias("n")).collect()
    if len(seen) < 2:
        share = float(bool(seen and seen[0]["_y"]))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    best = log_count_ratios(sample, GRAMS, features)
    buckets, ratios = best["bucket"].to_numpy(np.int64), best["ratio"].to_numpy(float)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = placement(buckets)
        for batch in batches:
            yield pd.DataFrame({
                "cols": [GRAMS.columns(t, place).tolist() for t in batch["text"]], "y": batch["_y"], "rate": batch["_rate"],
            })

    # At most fit_rows rows of at most `features` numbers.
    data = sample.mapInPandas(rows, "cols array<int>, y int, rate double").toPandas()
    x = Sparse.of(list(data["cols"]), ratios)
    weight = 1 / data["rate"].to_numpy(float)
    w = logistic(x, data["y"].to_numpy(float), weight / weight.mean(), l2)
    return Model(buckets, w[:-1] * ratios, float(w[-1]))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Whole texts are scored, a very long one piece by piece.  Null and empty texts are scored as a
    text without n-grams; null and repeated ids are ordinary rows; labels with null id or value
    are not used; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, **options)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.scores(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with a score below one half, all columns kept."""
    return docs.filter(fit(docs, labels, **options).scores(F.col("text")) < 0.5)
