"""Means, co-moments and moments of sliding windows, without the cancellation of raw sums of squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cell holds as many rows of the co-moment matrix as fit into so many bytes (one row at least).
CELL_BYTES = 1 << 19
#: Cells of one stripe are first merged in so many groups of tasks.
FOLDS = 32
_CELL = "first int, n long, mean binary, scatter binary"


def _merge(a: tuple, b: tuple, first: int) -> tuple:
    """Moments ``(n, mean, scatter)`` of the rows of both; ``scatter`` starts at row ``first`` of the matrix."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    mine = gap[first:first + len(a[2])]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(mine, gap) * (a[0] * b[0] / n)


def co_moments(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Moments of the vectors that are not null, as cells ``first, n, mean, scatter``.

    A cell has the rows from ``first`` of the matrix of centred products, and the whole mean, as
    bytes of doubles.  Every task centres its rows and adds up one matrix; the cells of a stripe are
    merged pair by pair, in two levels, so a task holds one matrix or its stripes of it.  Vectors
    of up to 256 dimensions need one cell.  No rows give no cell.
    """
    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            mean = x.mean(axis=0)
            gap = x - mean
            # what rounding leaves of the mean is taken out of the products as well
            rest = gap.mean(axis=0)
            found = (len(x), mean + rest, gap.T @ gap - np.outer(rest, rest) * len(x))
            total = found if total is None else _merge(total, found, 0)
        if total is not None:
            n, mean, scatter = total
            high = max(1, CELL_BYTES // (8 * len(mean)))
            for first in range(0, len(mean), high):
                yield pd.DataFrame({
                    "first": [first], "n": [n], "mean": [mean.tobytes()],
                    "scatter": [scatter[first:first + high].tobytes()],
                })

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for pdf in batches:
            for first, cell in zip(pdf["first"], map(_cell, pdf.itertuples())):
                held[first] = _merge(held[first], cell, first) if first in held else cell
        for first, (n, mean, scatter) in held.items():
            yield pd.DataFrame({"first": [first], "n": [n], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})

    cells = df.filter(F.col(vec).isNotNull()).select(vec).mapInPandas(own, _CELL)
    some = cells.withColumn("_fold", F.pmod(F.spark_partition_id(), F.lit(FOLDS))).repartition("first", "_fold")
    return some.drop("_fold").mapInPandas(joined, _CELL).repartition("first").mapInPandas(joined, _CELL)


def _cell(row) -> tuple[int, np.ndarray, np.ndarray]:
    mean = np.frombuffer(row.mean, dtype=np.float64)
    return int(row.n), mean, np.frombuffer(row.scatter, dtype=np.float64).reshape(-1, len(mean))


def whole(cells: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """``n, mean, scatter`` of the cells on the driver: d x d numbers, whatever the number of rows."""
    found = sorted(cells.collect(), key=lambda r: r["first"])
    if not found:
        return None
    parts = [_cell(r) for r in found]
    return parts[0][0], parts[0][1].copy(), np.vstack([p[2] for p in parts])


def long_form(cells: DataFrame) -> DataFrame:
    """Sample covariance (n - 1) as rows ``i, j, cov``; null where there is one row."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                n, mean, scatter = _cell(row)
                i, j = np.indices(scatter.shape)
                cov = scatter.ravel() / (n - 1) if n > 1 else np.full(scatter.size, None, dtype=object)
                yield pd.DataFrame({"i": i.ravel() + row.first, "j": j.ravel(), "cov": cov})

    return cells.mapInPandas(each, "i int, j int, cov double")


def window_moments(
    x: np.ndarray, pos: np.ndarray, capacity: int, rows: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, mean and scatter (sum of squared distances from the mean) of the rows before each of ``rows``.

    The window of a row is the ``min(pos, capacity)`` rows before it, all of which ``x`` must hold;
    ``pos`` counts from 0 in each session.  Sessions are cut into stretches of ``capacity`` rows,
    so a window is the end of one stretch and the beginning of the next.  Sums of an end
    (a beginning) are taken relative to its last (first) row, which belongs to it: what cancels is
    at most ``capacity`` times what is left.  The cost per row does not depend on the capacity.
    """
    size = np.minimum(pos[rows], capacity)
    begins = np.flatnonzero(np.append(True, (pos[1:] % capacity == 0) | (pos[1:] != pos[:-1] + 1)) if len(x) else [])
    ends = np.append(begins[1:], len(x))
    stretch = np.repeat(np.arange(len(begins)), ends - begins)
    forward, backward = np.empty_like(x), np.empty_like(x)
    forward_squares, backward_squares = np.empty(len(x)), np.empty(len(x))
    for a, b in zip(begins, ends):
        y = x[a:b] - x[a]
        forward[a:b] = np.cumsum(y, axis=0)
        forward_squares[a:b] = np.cumsum(np.einsum("ij,ij->i", y, y))
        y = (x[a:b] - x[b - 1])[::-1]
        backward[a:b] = np.cumsum(y, axis=0)[::-1]
        backward_squares[a:b] = np.cumsum(np.einsum("ij,ij->i", y, y))[::-1]

    last = np.maximum(rows - 1, 0)
    at = stretch[last] if len(x) else last
    n = np.where(size > 0, np.minimum(size, rows - begins[at]), 0) if len(x) else size
    mean, scatter = _about(forward[last], forward_squares[last], n, x[begins[at]])
    m = size - n
    low = np.where(m > 0, rows - size, 0)
    other, spread = _about(backward[low], backward_squares[low], m, x[ends[stretch[low]] - 1])
    gap, total = other - mean, np.maximum(size, 1)
    scatter = scatter + np.where(m > 0, spread + np.einsum("ij,ij->i", gap, gap) * n * m / total, 0.0)
    return size, np.where((m > 0)[:, None], mean + gap * (m / total)[:, None], mean), scatter


def _about(sums: np.ndarray, squares: np.ndarray, n: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter of n rows from sums and sums of squares relative to an origin."""
    some = np.maximum(n, 1)
    shift = sums / some[:, None]
    scatter = np.maximum(0.0, squares - n * np.einsum("ij,ij->i", shift, shift))
    return np.where((n > 0)[:, None], origin + shift, 0.0), np.where(n > 0, scatter, 0.0)
