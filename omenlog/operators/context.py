"""Distance of each vector to the memory of the previous rows of its session.

The memory of row i is the previous ``capacity`` rows of its key.  Rows are laid out in
blocks that carry the tail of the block before (``order.blocks``), so each Python task
handles a bounded matrix whatever the size of a session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.moments import window_moments
from omenlog.operators.order import Order, blocks, ordinal
from omenlog.session import checkpointed

BLOCK_ROWS = 8192
CHUNK = 256


def _matrix(pdf: pd.DataFrame, column: str = "vec") -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(np.float64)


def _scan(
    df: DataFrame,
    fn: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    fields: str,
    *,
    halo: int,
    order: Order,
    extra: Sequence[str] = (),
    sides: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``fn(block, positions, own rows)`` over blocks; it returns one row per own row.

    ``sides`` (``_session, _side``) adds one value per session; each block gets those of the
    sessions in it, one row each.
    """
    keys = list(order.keys)
    columns = list(dict.fromkeys([*keys, *order.by, "line_id", "vec", *extra]))
    laid = blocks(df.select(*columns), order, halo, block_rows).drop("_home")
    named = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {named[k]}" for k in keys), "line_id bigint", fields])

    names = [*keys, "line_id", *(f.split()[0] for f in fields.split(", "))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord", kind="stable").reset_index(drop=True)
        own = np.flatnonzero(pdf["_own"].to_numpy())
        if len(own) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        out = fn(pdf, pdf["_pos"].to_numpy(), own)
        head = pdf.iloc[own][[*keys, "line_id"]].reset_index(drop=True)
        return pd.concat([head, out.reset_index(drop=True)], axis=1)

    if sides is None:
        return laid.groupBy("_block").applyInPandas(run, schema)
    laid = checkpointed(laid.withColumn("_session", _session(order)))
    here = laid.select(F.col("_block").alias("_at"), F.col("_session").alias("_of")).distinct()
    here = checkpointed(here.join(sides, here["_of"] == sides["_session"]).select("_at", "_of", "_side"))

    def beside(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        side = dict(zip(known["_of"], known["_side"])) if len(known) else {}
        return run(pdf.assign(_side=[side.get(s) for s in pdf["_session"]]))

    return laid.groupBy("_block").cogroup(here.groupBy("_at")).applyInPandas(beside, schema)


def _starts(pos: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each row's memory inside its block."""
    size = np.minimum(pos, capacity)
    return np.arange(len(pos)) - size, size


def statistics_of(x: np.ndarray, pos: np.ndarray, rows: np.ndarray, capacity: int) -> pd.DataFrame:
    """``n, mean, total_variance`` of the memory of each of ``rows``."""
    n, mean, scatter = window_moments(x, pos, capacity, rows)
    return pd.DataFrame({
        "n": n, "mean": [m if k else None for m, k in zip(mean.tolist(), n)],
        "total_variance": np.where(n > 1, scatter / np.maximum(n - 1, 1), np.nan),
    })


def cosine_of(
    x: np.ndarray, pos: np.ndarray, rows: np.ndarray, capacity: int, min_samples: int, missing: float = np.nan,
) -> np.ndarray:
    """Cosine distance of each of ``rows`` to the mean of its memory."""
    size, mean, _ = window_moments(x, pos, capacity, rows)
    mine = x[rows]
    norms = np.linalg.norm(mine, axis=1) * np.linalg.norm(mean, axis=1)
    dots = np.einsum("ij,ij->i", mine, mean)
    far = np.where(norms == 0, 1.0, 1.0 - dots / np.where(norms == 0, 1.0, norms))
    return np.where(size < min_samples, missing, far)


def memory_statistics(
    df: DataFrame, capacity: int = 128, *, order: Order | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Size, mean and total variance (trace of the covariance, n - 1) of each row's memory."""
    order = order or Order()

    def fn(pdf, pos, own):
        return statistics_of(_matrix(pdf), pos, own, capacity)

    return _scan(df, fn, "n bigint, mean array<double>, total_variance double",
                 halo=capacity, order=order, block_rows=block_rows)


def cosine(
    df: DataFrame, capacity: int = 128, min_samples: int = 10, *, order: Order | None = None,
    not_ready: float | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cosine distance to the mean of the memory; ``not_ready`` until it has enough rows."""
    order = order or Order()
    missing = np.nan if not_ready is None else not_ready

    def fn(pdf, pos, own):
        return pd.DataFrame({"distance": cosine_of(_matrix(pdf), pos, own, capacity, min_samples, missing)})

    return _nullable(_scan(df, fn, "distance double", halo=capacity, order=order, block_rows=block_rows))


def _nullable(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def _aggregate(found: np.ndarray, how: str) -> np.ndarray:
    if how == "mean":
        return found.mean(axis=1)
    if how == "max":
        return found.max(axis=1)
    if how == "median":
        return np.median(found, axis=1)
    if how == "harmonic":
        return found.shape[1] / (1.0 / (found + 1e-10)).sum(axis=1)
    raise ValueError(f"unknown aggregate: {how}")


def _nearest(x: np.ndarray, lo: np.ndarray, size: np.ndarray, rows: np.ndarray, k: int, how: str) -> np.ndarray:
    """Aggregate distance to the k nearest memory rows, in chunks of rows."""
    squares = np.einsum("ij,ij->i", x, x)
    out = np.full(len(rows), np.nan)
    ready = np.flatnonzero(size[rows] >= k)
    for at in range(0, len(ready), CHUNK):
        part = ready[at:at + CHUNK]
        mine = rows[part]
        first, last = lo[mine].min(), mine.max()
        gap = squares[mine][:, None] + squares[first:last][None, :] - 2.0 * (x[mine] @ x[first:last].T)
        place = np.arange(first, last)[None, :]
        gap[(place < lo[mine][:, None]) | (place >= mine[:, None])] = np.inf
        near = np.argpartition(gap, k - 1, axis=1)[:, :k]
        # the chosen neighbours again, without the cancellation of the product form
        exact = np.linalg.norm(x[first + near] - x[mine][:, None, :], axis=2)
        out[part] = _aggregate(exact, how)
    return out


def knn(
    df: DataFrame, capacity: int = 128, k: int = 10, aggregate: str = "mean", *,
    order: Order | None = None, not_ready: float | None = None, pca: int | None = None,
    min_samples: int = 10, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Distance to the k nearest rows of the memory, aggregated over the k.

    With ``pca`` rows after the warm-up are compared in the space of that many components,
    fitted once on the first ``max(min_samples, pca + 1)`` rows of their own session.
    """
    order = order or Order()
    missing = np.nan if not_ready is None else not_ready
    warm = max(min_samples, (pca or 0) + 1)

    def fn(pdf, pos, own):
        lo, size = _starts(pos, capacity)
        early = own if pca is None else own[pos[own] < warm]
        found = np.full(len(own), np.nan)
        found[np.isin(own, early)] = _nearest(_matrix(pdf), lo, size, early, k, aggregate)
        if pca is not None:
            late = own[pos[own] >= warm]
            found[np.isin(own, late)] = _nearest(_projected(pdf, pca), lo, size, late, k, aggregate)
        return pd.DataFrame({"distance": np.where(size[own] < k, missing, found)})

    sides = None if pca is None else bases(df, pca, warm, order)
    return _nullable(_scan(df, fn, "distance double", halo=capacity, order=order, sides=sides, block_rows=block_rows))


def _projected(pdf: pd.DataFrame, components: int) -> np.ndarray:
    """The vectors of a block in the space of their own session (zeros where it is not fitted yet)."""
    x = _matrix(pdf)
    out = np.zeros((len(x), components))
    for _, rows in pdf.groupby("_session").indices.items():
        basis = pdf["_side"].iloc[rows[0]]
        if basis is not None:
            axes = np.asarray(basis, dtype=np.float64).reshape(-1, x.shape[1])
            out[rows, : len(axes)] = x[rows] @ axes.T
    return out


def _session(order: Order) -> Column:
    return F.xxhash64(*order.keys) if order.keys else F.lit(0).cast("long")


def bases(df: DataFrame, components: int, warm: int, order: Order) -> DataFrame:
    """``_session, _side``: the leading components of the first ``warm`` rows of each session.

    At most ``min(components, warm - 1, dimensions)`` axes, one after the other.  A session with
    fewer rows has none and needs none.
    """
    columns = list(dict.fromkeys([*order.keys, *order.by, "vec"]))
    first = ordinal(df.select(*columns), order, "_pos").filter(F.col("_pos") < warm)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("_pos"))
        axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][: min(components, len(x) - 1, x.shape[1])]
        return pd.DataFrame({"_session": [pdf["_session"].iloc[0]], "_side": [axes.ravel() if len(x) == warm else None]})

    return first.withColumn("_session", _session(order)).groupBy("_session").applyInPandas(
        fit, "_session long, _side array<double>")


def shrinkage(n: int, d: int, spread: float, manual: float | None = None) -> float:
    """Weight of the scaled identity: manual, 0.5 with too few rows, else 1/d."""
    if manual is not None:
        return manual
    if n < d or spread <= 0:
        return 0.5
    return min(1.0, 1.0 / d)


def shrunk_inverse(rows: np.ndarray, manual: float | None = None) -> np.ndarray:
    """Inverse of the shrunk covariance of the memory, with a small ridge."""
    n, d = rows.shape
    cov = np.cov(rows, rowvar=False).reshape(d, d) if n > 1 else np.eye(d)
    level = np.trace(cov) / d
    alpha = shrinkage(n, d, float(((cov - level * np.eye(d)) ** 2).sum()), manual)
    mixed = (1 - alpha) * cov + alpha * level * np.eye(d)
    try:
        return np.linalg.inv(mixed + 1e-6 * np.eye(d))
    except np.linalg.LinAlgError:
        return np.linalg.pinv(mixed)


def mahalanobis_of(
    x: np.ndarray, pos: np.ndarray, rows: np.ndarray, capacity: int, min_samples: int, refresh: int,
    manual_shrinkage: float | None = None, missing: float = np.nan, known: tuple[int, np.ndarray] | None = None,
) -> tuple[np.ndarray, tuple[int, np.ndarray] | None]:
    """Mahalanobis distance of each of ``rows``, and the last inverse with the position it was made at.

    ``known`` is such a pair from earlier rows of the only session in ``x``.
    """
    size, mean, _ = window_moments(x, pos, capacity, rows)
    out, last = np.full(len(rows), missing), known
    renewed = np.maximum(min_samples, refresh * (pos[rows] // refresh))
    base = rows - pos[rows]  # index where the key starts (may lie before the block)
    ready = np.flatnonzero(size >= min_samples)
    marks = pd.Series(list(zip(base[ready], renewed[ready])), dtype=object)
    for (start, at), same in marks.groupby(marks, sort=False).indices.items():
        mine = ready[same]
        if known is not None and known[0] == at:
            inverse = known[1]
        else:
            inverse = shrunk_inverse(x[start + max(0, at - capacity):start + at], manual_shrinkage)
        last = int(at), inverse
        gap = x[rows[mine]] - mean[mine]
        out[mine] = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", gap, inverse, gap)))
    return out, last


def mahalanobis(
    df: DataFrame, capacity: int = 128, min_samples: int = 10, refresh: int = 128, *,
    manual_shrinkage: float | None = None, order: Order | None = None,
    not_ready: float | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mahalanobis distance to the memory.

    The mean is always current.  The inverse covariance is renewed every ``refresh`` rows:
    for the row at position i it comes from the memory of position
    ``max(min_samples, refresh * (i // refresh))``.
    """
    order = order or Order()
    missing = np.nan if not_ready is None else not_ready

    def fn(pdf, pos, own):
        far, _ = mahalanobis_of(_matrix(pdf), pos, own, capacity, min_samples, refresh, manual_shrinkage, missing)
        return pd.DataFrame({"distance": far})

    return _nullable(_scan(df, fn, "distance double", halo=capacity + refresh, order=order, block_rows=block_rows))


METRICS: dict[str, Callable[..., DataFrame]] = {"cosine": cosine, "knn": knn, "mahalanobis": mahalanobis}


def context_distance(df: DataFrame, metric: str = "mahalanobis", **options) -> DataFrame:
    """Distance to the session memory by metric name."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric} (one of {sorted(METRICS)})")
    return METRICS[metric](df, **options)


def similarity_margin(
    df: DataFrame, rows: int = 50, margin: float = 0.5, normals: int = 10, *,
    order: Order | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean over failures of ``max(0, margin - cos(early, failure) + mean early . normal)``.

    ``early`` are the previous rows; the normals are a fixed draw by hash of the line.
    """
    order = order or Order()
    draw = df.filter("label = 0").orderBy(F.md5(F.col("line_id").cast("string")), "line_id").limit(normals)
    sample = [r["vec"] for r in draw.select("vec").collect()]  # ``normals`` rows
    reference = np.asarray(sample, dtype=np.float64)

    def fn(pdf, pos, own):
        x = _matrix(pdf)
        lo, size = _starts(pos, rows)
        failed = (pdf["label"].to_numpy()[own] == 1) & (size[own] > 0)
        out = np.full(len(own), np.nan)
        norms = np.linalg.norm(x, axis=1)
        against = (x @ reference.T).mean(axis=1) if len(reference) else np.zeros(len(x))
        for j in np.flatnonzero(failed):
            i = own[j]
            early = slice(lo[i], i)
            cos = x[early] @ x[i] / np.maximum(norms[early] * norms[i], 1e-8)
            out[j] = np.maximum(0.0, margin - cos + against[early]).mean()
        return pd.DataFrame({"margin": out})

    scored = _scan(df, fn, "margin double", halo=rows, order=order, extra=("label",), block_rows=block_rows)
    return scored.filter("margin is not null and not isnan(margin)").agg(
        F.count("*").alias("failures"), F.coalesce(F.avg("margin"), F.lit(0.0)).alias("margin")
    )
