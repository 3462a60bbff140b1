"""Character n-gram features and a logistic regression over sparse rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.session import checkpointed

#: n-grams are hashed into so many buckets; the fit picks the telling ones.
BUCKETS = 1 << 20
#: Texts are hashed in pieces of so many characters, so memory does not grow with a text.
PIECE = 1 << 18


@dataclass(frozen=True)
class Grams:
    """Which character n-grams of a text are its features."""

    sizes: tuple[int, ...]
    lower: bool = True

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """Bucket numbers of the n-grams of each piece of the text, white space run together."""
        text = " " + " ".join((text or "").split()) + " "
        text = text.lower() if self.lower else text
        for at in range(0, len(text), PIECE):
            part = text[max(0, at - max(self.sizes) + 1): at + PIECE]
            chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            h = chars.copy()
            for n in range(1, max(self.sizes) + 1):
                if n > 1:
                    h = h[:-1] * np.uint32(0x01000193) + chars[n - 1:]
                if n in self.sizes:
                    yield ((h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(12)

    def distinct(self, text: str | None) -> np.ndarray:
        """All distinct buckets of the text."""
        seen = np.zeros(BUCKETS, dtype=bool)
        for buckets in self.pieces(text):
            seen[buckets] = True
        return np.flatnonzero(seen)

    def columns(self, text: str | None, place: np.ndarray) -> np.ndarray:
        """The distinct feature numbers of the text; ``place`` maps buckets to them (-1: none)."""
        found = [hit[hit >= 0] for hit in (place[b] for b in self.pieces(text))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, place.dtype)


def placement(buckets: np.ndarray) -> np.ndarray:
    """Bucket -> feature number, -1 for buckets that are no feature."""
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    return place


def log_count_ratios(sample: DataFrame, grams: Grams, features: int, least: int = 3) -> pd.DataFrame:
    """``bucket, ratio`` of the most telling buckets of ``sample(text, _y)``.

    ratio is the naive Bayes log-count ratio log((1 + p) / |1 + p|) - log((1 + q) / |1 + q|) over
    documents that hold the bucket; features are ranked by |ratio| * sqrt(documents).  Counts are
    summed per task before the shuffle.
    """
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            for text, y in zip(batch["text"], batch["_y"]):
                total[int(y), grams.distinct(text)] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": used, "q": total[0, used], "p": total[1, used]}, dtype="int64")

    found = sample.select("text", "_y").mapInPandas(counts, "bucket long, q long, p long")
    found = checkpointed(found.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    sums = found.agg(F.sum(F.col("p") + 1).alias("p"), F.sum(F.col("q") + 1).alias("q")).first()
    ratio = F.log((F.col("p") + 1) / F.lit(float(sums["p"] or 1))) - F.log((F.col("q") + 1) / F.lit(float(sums["q"] or 1)))
    docs = F.col("p") + F.col("q")
    best = found.filter(docs >= least).select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(docs)).alias("rank"))
    return best.orderBy(F.desc("rank"), "bucket").limit(features).toPandas()


@dataclass
class Sparse:
    """Rows of features: entry i is ``scale[cols[i]]`` at (``rows[i]``, ``cols[i]``)."""

    rows: np.ndarray
    cols: np.ndarray
    scale: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(lists: list, scale: np.ndarray) -> Sparse:
        rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        cols = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        return Sparse(rows, cols, scale, (len(lists), len(scale)))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=(self.scale * w)[self.cols], minlength=self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return self.scale * np.bincount(self.cols, weights=g[self.rows], minlength=self.shape[1])


@dataclass
class Dense:
    """Rows of a few numbers."""

    values: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return self.values.shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.values @ w

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return self.values.T @ g


def loss_and_gradient(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted logistic loss of weights and intercept (last), and its gradient."""
    z = x.times(w[:-1]) + w[-1]
    g = weight * (sigmoid(z) - y)
    return float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()), np.append(x.transposed_times(g), g.sum())


def penalised(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, l2: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The same with a ridge penalty on all but the intercept, as a function of the weights."""
    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = loss_and_gradient(x, y, weight, w)
        return value + float(l2 / 2 * (w[:-1] ** 2).sum()), grad + l2 * np.append(w[:-1], 0.0)

    return loss


def logistic(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 60) -> np.ndarray:
    """Weights and intercept (last) of a weighted, ridge-penalised logistic regression."""
    return minimised(penalised(x, y, weight, l2), np.zeros(x.shape[1] + 1), rounds)


def minimised(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, least: float = 1e-7,
) -> np.ndarray:
    """Where ``loss`` (value and gradient) is smallest, from ``w`` on (L-BFGS), until a step gains less than ``least``."""
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, back = grad.copy(), []
        for s, d in reversed(steps):
            a = s @ q / (s @ d)
            q -= a * d
            back.append(a)
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(grad).sum())
        for (s, d), a in zip(steps, reversed(back)):
            q += (a - d @ q / (s @ d)) * s
        rate, slope = 1.0, grad @ q
        while True:
            new = w - rate * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, d = new - w, new_grad - grad
        done = value - new_value <= least * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
        if s @ d > 1e-12:
            steps = [*steps[-9:], (s, d)]
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


