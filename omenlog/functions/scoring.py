"""Score arithmetic on columns: pooling, ensembles, confidence weights, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from omenlog.functions.binding import bound

POOLING = ("mean", "max", "topk_mean", "bottomk_mean", "pctl")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def array_mean(values: Column) -> Column:
    """Mean of an array of doubles, 0 when empty."""
    return bound(
        values, lambda v: F.when(F.size(v) > 0, array_sum(v) / F.size(v)).otherwise(0.0)
    )


def pool(values: Column, mode: str, k: float | Column = 5) -> Column:
    """Reduce the per-word surprises of a line to one score; empty lines score 0.

    ``k`` is the number of words for topk/bottomk and the percentile for pctl.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    if mode == "mean":
        return array_mean(values)
    if mode == "max":
        return F.coalesce(F.array_max(values), F.lit(0.0))
    if mode == "topk_mean":
        return array_mean(F.slice(F.sort_array(values, asc=False), F.lit(1), k.cast("int")))
    if mode == "bottomk_mean":
        return array_mean(F.slice(F.sort_array(values), F.lit(1), k.cast("int")))
    if mode == "pctl":
        at = (F.size(values) - 1) * k / 100

        def between(ordered: Column) -> Column:
            low = F.get(ordered, F.floor(at).cast("int"))
            high = F.get(ordered, F.ceil(at).cast("int"))
            return low + (high - low) * (at - F.floor(at))

        return F.when(F.size(values) > 0, bound(F.sort_array(values), between)).otherwise(0.0)
    raise ValueError(f"unknown pooling mode: {mode} (one of {POOLING})")


#: Values that are sorted at once, in rows of about the same length.
CELLS = 1 << 21


def extreme_means(lists: pa.Array, ks: Sequence[int]) -> tuple[list[pa.Array], list[pa.Array]]:
    """``pool`` of a batch of arrays by ``topk_mean`` and by ``bottomk_mean``, for every k.

    Each array is sorted once for all; values are added in the order in which ``pool`` adds them.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    gone = flat.is_null().to_numpy(zero_copy_only=False)
    lost = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[gone], minlength=len(sizes))
    flat = np.where(gone, -np.inf, flat.cast(pa.float64()).to_numpy(zero_copy_only=False))  # nulls sort below all
    starts = np.cumsum(sizes) - sizes
    most = max(ks, default=0)
    best = np.zeros((2, most + 1, len(sizes)))  # sums of the j highest and lowest
    steps = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), -1).astype(np.int64)
    for step in np.unique(steps[steps >= 0]):
        rows, width = np.flatnonzero(steps == step), 1 << int(step)
        for some in np.array_split(rows, -(-len(rows) * width // CELLS)):
            n, across = sizes[some], np.arange(width)
            cells = flat[np.minimum(starts[some][:, None] + across, len(flat) - 1)]
            cells[across >= n[:, None]] = np.nan  # behind all others
            cells.sort(axis=1)
            for j in range(most):
                here = np.arange(len(some))
                for side, at in enumerate((n - 1 - j, np.full(len(some), j))):
                    x = cells[here, np.clip(at, 0, width - 1)]
                    best[side, j + 1, some] = best[side, j, some] + np.where(j < n, x, 0.0)
    out = [], []
    for k in ks:
        n = np.minimum(sizes, k)
        for side, none in enumerate((n > sizes - lost, (lost > 0) & (n > 0))):
            means = np.where(n > 0, best[side, k] / np.maximum(n, 1), 0.0)
            out[side].append(pa.array(means, mask=none))
    return out


def ensemble(scores: Sequence[Column], ks: Sequence[int], how: str = "mean") -> Column:
    """Combine the scores of several k: mean, weighted_mean (by 1/k) or max."""
    if how == "max":
        return F.greatest(*scores)
    if how == "mean":
        weights = [1.0 / len(ks)] * len(ks)
    elif how == "weighted_mean":
        total = sum(1.0 / k for k in ks)
        weights = [1.0 / k / total for k in ks]
    else:
        raise ValueError(f"unknown ensemble: {how}")
    terms = [s * F.lit(w) for s, w in zip(scores, weights)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def softmax(values: Column) -> Column:
    """Softmax of an array of doubles."""

    def share(exps: Column) -> Column:
        return bound(array_sum(exps), lambda total: F.transform(exps, lambda x: x / total))

    def powers(v: Column) -> Column:
        return bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    return bound(bound(values, powers), share)


def confidence_alpha(probs: Column, low: float = 0.5, high: float = 0.95) -> Column:
    """Blend weight that falls from ``high`` to ``low`` with the entropy of ``probs``."""
    entropy = -F.aggregate(probs, F.lit(0.0), lambda s, p: s + p * F.log(p + F.lit(1e-10)))
    return F.lit(high) - entropy / F.log(F.size(probs).cast("double")) * F.lit(high - low)


def recommendation(f1: Column, ewr: Column, roi: Column) -> Column:
    """Deployment tier from F1, warning rate (percent) and return on investment."""
    return (
        F.when((f1 >= 0.9) & (ewr >= 30) & (roi >= 2.0), "ready")
        .when((f1 >= 0.8) & (ewr >= 20) & (roi >= 1.0), "pilot")
        .when((f1 >= 0.7) & (ewr >= 10), "needs improvement")
        .otherwise("not ready")
    )


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(
        array_sum(
            F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
        )
    )
