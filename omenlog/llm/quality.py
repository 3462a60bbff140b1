"""Quality: co-training of a text-content and a page-metadata classifier, calibrated and combined."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.llm.common import labelled, share
from omenlog.llm.linear import (
    Dense, Grams, Sparse, log_count_ratios, logistic, loss_and_gradient, minimised, penalised, placement, sigmoid,
)
from omenlog.session import checkpointed

GRAMS = Grams(sizes=(2, 3, 4), lower=False)
#: Bound of the labelled sample; every unlabelled document takes part.
FIT_ROWS = 4_096
FEATURES = 1 << 12
ROUNDS = 4
#: Steps of a round's fit, which goes on from the weights of the round before.
STEPS = 12
#: Log-odds above which a view is sure of a document and teaches it to the other one.
SURE = float(np.log(19))

_SLOTS = 1 << 12  # hashed metadata features
#: Groups of tasks whose vectors are added before they come to the driver.
FOLDS = 32
_CHUNK = 512  # unlabelled documents that a task unpacks at a time


def _metadata(text: str | None, lang: str | None, source: str | None, n_chars: str | None) -> list[int]:
    """What is known of a page without its words (language, source, size, layout), as hashed features."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.count("\n") + 1
    symbols = len(re.findall(r"[^\w\s.,;:'\"()-]", text))
    upper = sum(map(str.isupper, words))
    again = sum(map(str.__eq__, words[:-1], words[1:]))
    names = [
        f"lang={lang}", f"source={source}", f"chars={len(n_chars or '')}", f"length={len(text).bit_length()}",
        f"lines={lines.bit_length()}", f"per_line={(len(words) // lines).bit_length()}", f"word={min(20, round(len(text) / m))}",
        f"symbols={min(20, int(100 * symbols / n + 0.999))}", f"upper={min(10, int(20 * upper / m + 0.999))}",
        f"again={min(10, int(20 * again / m + 0.999))}", f"distinct={int(10 * len(set(words)) / m)}",
    ]
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % _SLOTS for x in names})


@dataclass(frozen=True)
class Model:
    """Weights of both views (intercept last), the line that calibrates each, and the prior log-odds."""

    buckets: np.ndarray
    text: np.ndarray
    metadata: np.ndarray
    text_line: tuple[float, float]
    metadata_line: tuple[float, float]
    prior: float

    def scores(self, docs: DataFrame) -> Column:
        """A struct of the probability of label 1 by ``text``, by ``metadata`` and by both, ``score``."""
        model = self

        def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            place = placement(model.buckets)
            for texts, *others in batches:
                a = [model.text[:-1][GRAMS.columns(t, place)].sum() for t in texts]
                b = [model.metadata[:-1][_metadata(*row)].sum() for row in zip(texts, *others)]
                a = model.text_line[0] * (np.array(a, dtype=float) + model.text[-1]) + model.text_line[1]
                b = model.metadata_line[0] * (np.array(b, dtype=float) + model.metadata[-1]) + model.metadata_line[1]
                yield pd.DataFrame({"text": sigmoid(a), "metadata": sigmoid(b), "score": sigmoid(a + b - model.prior)})

        udf = F.pandas_udf(each, "text double, metadata double, score double")
        return udf(*(docs[c].cast("string") for c in ("text", "lang", "source", "n_chars")))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """``text, lang, source, n_chars, _y, _rate, _check``: a bounded sample of the labelled documents.

    Of the rows of a repeated id the least one stands for the id.
    """
    narrow = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source", "n_chars")))
    known = labelled(narrow, labels, "quality", fit_rows)
    known = known.groupBy("doc_id").agg(F.min(F.struct(*(c for c in known.columns if c != "doc_id"))).alias("r"))
    known = known.select("doc_id", "r.*").withColumn("_check", share(F.col("doc_id"), 3) < 0.2)
    return checkpointed(known.drop("doc_id").repartition(8))


def _odds(lists: list, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    return Sparse.of(lists, scale).times(w[:-1]) + w[-1]


#: Rows of both views, text first.
Views = tuple[Sparse | Dense, Sparse | Dense]


def _sure(rows: Views, teachers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each view is told by the other one: the labels, and whether the teacher is sure."""
    odds = [x.times(w[:-1]) + w[-1] for x, w in zip(rows, teachers)]
    return [((z > 0).astype(int), np.abs(z) > SURE) for z in reversed(odds)]


def _told(rows: Views, teachers: list[np.ndarray]) -> np.ndarray:
    """How many rows each view is told to be of label 0 and of label 1."""
    return np.array([np.bincount(y[sure], minlength=2) for y, sure in _sure(rows, teachers)], dtype=float)


def _lesson(rows: Views, teachers: list[np.ndarray], worth: np.ndarray, pupils: list[np.ndarray]) -> np.ndarray:
    """The loss of both pupils on what they are told, and its gradients, one after the other."""
    out = [[0.0]]
    for x, (y, sure), worths, w in zip(rows, _sure(rows, teachers), worth, pupils):
        value, grad = loss_and_gradient(x, y, worths[y] * sure, w)
        out[0][0] += value
        out.append(grad)
    return np.concatenate(out)


@dataclass(frozen=True)
class Pool:
    """The unlabelled documents ``a`` (packed text features), ``b`` (metadata features) of a table."""

    table: DataFrame
    features: int

    def sums(self, of: Callable[..., np.ndarray], *args) -> np.ndarray:
        """The sum of ``of(rows, *args)`` over all rows.

        Every task adds up its rows, the vectors of the tasks are added by their number modulo
        ``FOLDS``, and at most so many vectors come to the driver, however many tasks there are.
        """
        features = self.features

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, _CHUNK):
                    rows = batch.slice(at, _CHUNK)
                    found = of((_unpacked(rows.column(0), features), _sparse(rows.column(1))), *args)
                    total = found if total is None else total + found
            if total is not None:
                fold = TaskContext.get().partitionId() % FOLDS
                arrays = [pa.array([fold], pa.int32()), pa.array([total.ravel().tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["fold", "v"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for v in batch.column("v"):
                    found = np.frombuffer(v.as_buffer())
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        parts = self.table.mapInArrow(each, "fold int, v binary").repartition("fold")
        return sum(np.frombuffer(r["v"]) for r in parts.mapInArrow(added, "v binary").collect())


@dataclass(frozen=True)
class Local:
    """Unlabelled documents that the driver holds, as feature lists by view."""

    lists: list[list]
    widths: tuple[int, int]

    def sums(self, of: Callable[..., np.ndarray], *args) -> np.ndarray:
        if not self.lists[0]:
            return np.zeros(1)
        return of(tuple(Sparse.of(x, np.ones(n)) for x, n in zip(self.lists, self.widths)), *args).ravel()


def _packed(columns: np.ndarray, features: int) -> bytes:
    has = np.zeros(features, dtype=bool)
    has[columns] = True
    return np.packbits(has).tobytes()


def _unpacked(column: pa.Array, features: int) -> Dense:
    whole = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -(-features // 8))
    return Dense(np.unpackbits(whole, axis=1, count=features).astype(float))


def _sparse(column: pa.Array) -> Sparse:
    rows = np.repeat(np.arange(len(column), dtype=np.int32), column.value_lengths().to_numpy(zero_copy_only=False))
    return Sparse(rows, column.flatten().to_numpy(zero_copy_only=False), np.ones(_SLOTS), (len(column), _SLOTS))


def _unlabelled(docs: DataFrame, labels: DataFrame, buckets: np.ndarray) -> Pool:
    """Every document without a label of its quality, by its features."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = placement(buckets)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "a": [_packed(GRAMS.columns(t, place), len(buckets)) for t in batch["text"]],
                "b": [_metadata(*row) for row in zip(*(batch[c] for c in ("text", "lang", "source", "n_chars")))],
            })

    named = labels.filter("doc_id IS NOT NULL AND CAST(quality AS INT) IN (0, 1)")
    named = named.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    narrow = docs.select(*(F.col(c).cast("string").alias(c) for c in ("doc_id", "text", "lang", "source", "n_chars")))
    # Texts stay where they are: features and ids, a few hundred bytes a document, meet the labels.
    found = narrow.mapInPandas(rows, "doc_id string, a binary, b array<int>").join(named, "doc_id", "left_anti")
    return Pool(checkpointed(found.select("a", "b")), len(buckets))


def co_train(
    views: list[list], scales: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pool: Pool | list[list],
    rounds: int, l2: float,
) -> list[np.ndarray]:
    """The weights of both views after exchanging confident pseudo-labels of the pool.

    ``views`` holds the feature lists of the labelled documents by view; ``pool`` has all
    unlabelled ones.  In every round each view judges the whole pool; all documents it is sure of
    (above 19 to 1) become labels of the other view.  Of the two classes the one above its share
    among the labels weighs less than 1 a document, so that the shares agree, and the labelled
    sample weighs at least as much as all that is taught.  A round's fit adds up loss and
    gradients over the pool where its rows are.
    """
    share_1 = float((weight * y).sum() / weight.sum())
    shares = np.array([1 - share_1, share_1])
    widths = (len(scales[0]), len(scales[1]))
    pool = Local(pool, widths) if isinstance(pool, list) else pool
    xs, own = [Sparse.of(v, s) for v, s in zip(views, scales)], weight / weight.mean()
    w = [logistic(x, y, own, l2) for x in xs]
    ends = np.cumsum([1, widths[0] + 1, widths[1] + 1])

    def plain(w: list[np.ndarray]) -> list[np.ndarray]:
        return [np.append(v[:-1] * s, v[-1]) for v, s in zip(w, scales)]

    for _ in range(rounds):
        teachers = plain(w)
        told = np.resize(pool.sums(_told, teachers), 4).reshape(2, 2)
        if not told.any():
            break
        # Of both classes as much as the scarcer one allows; a class that nobody is sure of limits nothing.
        most = np.where(told > 0, told / np.maximum(shares, 1e-9), np.inf).min(axis=1, keepdims=True)
        most = np.where(np.isfinite(most), most, 0.0)
        worth = np.minimum(1.0, most * shares / np.maximum(told, 1))
        more = np.maximum(1.0, (worth * told).sum(axis=1) / len(y))
        base = [penalised(x, y, own * m, l2) for x, m in zip(xs, more)]

        def loss(both: np.ndarray) -> tuple[float, np.ndarray]:
            now = [both[: ends[1] - 1], both[ends[1] - 1:]]
            taught = pool.sums(_lesson, teachers, worth, plain(now))
            value, grads = taught[0], []
            for f, v, s, at, until in zip(base, now, scales, ends, ends[1:]):
                mine, grad = f(v)
                value += mine
                grads.append(grad + taught[at:until] * np.append(s, 1.0))
            return float(value), np.concatenate(grads)

        both = minimised(loss, np.concatenate(w), rounds=STEPS, least=1e-4)
        w = [both[: ends[1] - 1], both[ends[1] - 1:]]
    return w


def _line(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's log-odds into calibrated ones."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    slope, offset = logistic(Dense(z[:, None]), y, weight / weight.mean(), 1e-2)
    return float(slope), float(offset)


def fit(
    docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, l2: float = 1.0,
) -> Model:
    """Co-train both views on a bounded labelled sample and on all unlabelled documents.

    One fifth of the labelled sample is kept from the fit to calibrate each view (a line in
    log-odds).  Without labels of both classes everything scores the share of label 1 (1 without
    any label, so that nothing is rejected unlearned).
    """
    sample = _sample(docs, labels, fit_rows)
    seen = {r["_y"]: r["n"] for r in sample.filter("NOT _check").groupBy("_y").agg(
        F.sum(1 / F.col("_rate")).alias("n")).collect()}
    if len(seen) < 2:
        odds = 20.0 if seen.get(1) or not seen else -20.0
        none = np.append(np.zeros(_SLOTS), odds)
        return Model(np.zeros(0, np.int64), np.array([odds]), none, (1.0, 0.0), (1.0, 0.0), odds)
    best = log_count_ratios(sample.filter("NOT _check"), GRAMS, FEATURES)
    buckets, ratios = best["bucket"].to_numpy(np.int64), best["ratio"].to_numpy(float)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = placement(buckets)
        for batch in batches:
            yield pd.DataFrame({
                "a": [GRAMS.columns(t, place).tolist() for t in batch["text"]],
                "b": [_metadata(*row) for row in zip(*(batch[c] for c in ("text", "lang", "source", "n_chars")))],
                "y": batch["_y"].astype("int32"), "rate": batch["_rate"], "held": batch["_check"],
            })

    # At most fit_rows rows of bounded width.
    data = sample.mapInPandas(rows, "a array<int>, b array<int>, y int, rate double, held boolean").toPandas()
    y, weight, held = data["y"].to_numpy(), 1 / data["rate"].to_numpy(float), data["held"].to_numpy(bool)
    lists = [list(data["a"]), list(data["b"])]
    train, check = (np.flatnonzero(m).tolist() for m in (~held, held))
    scales = [ratios, np.ones(_SLOTS)]
    w = co_train(
        [[v[i] for i in train] for v in lists], scales, y[train].astype(float), weight[train],
        _unlabelled(docs, labels, buckets), rounds, l2,
    )
    lines = [_line(_odds([v[i] for i in check], s, u), y[check].astype(float), weight[check]) if check else (1.0, 0.0)
             for v, s, u in zip(lists, scales, w)]
    prior = float(np.log(seen[1] / seen[0]))
    return Model(buckets, np.append(w[0][:-1] * ratios, w[0][-1]), w[1], lines[0], lines[1], prior)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, text_score, metadata_score, score, predicted: one row for each row of ``docs``.

    score is the probability of good quality by both views.  Whole texts are scored; null texts
    count as empty, null metadata as a value of its own; null and repeated ids are ordinary rows;
    an empty table gives an empty result; other columns are not read.
    """
    found = docs.select("doc_id", fit(docs, labels, **options).scores(docs).alias("s"))
    found = found.select("doc_id", F.col("s.text").alias("text_score"), F.col("s.metadata").alias("metadata_score"), "s.score")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not more likely of low quality than not, all columns kept."""
    return docs.filter(fit(docs, labels, **options).scores(docs)["score"] >= 0.5)
