"""Blends of two scores with many alphas, counted in NumPy where their rows stand.

A row of the written table ``pairs`` (``label, _a, _b, n``) is never copied per alpha: each task blends
its batches with one alpha after the other and keeps counts only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from math import ceil, floor, isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from omenlog.session import checkpointed

#: Bits of the first cut of a blend's range into cells, and of each further cut.
FIRST, FURTHER, DEEPEST = 13, 7, 48
#: Cells are cut further while they hold more rows than this; so many different values are sorted at most.
CANDIDATES, SORTED = 4_000_000, 8_000_000
#: Rows of one alpha that a task sorts, and rows whose blends move as one block.
PART_ROWS, BLOCK_ROWS = 2_000_000, 200_000


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """label, a, b, n and whether the blend is known."""
    for batch in batches:
        known = np.asarray(batch["_a"].is_valid()) & np.asarray(batch["_b"].is_valid())
        yield *(batch[c].to_numpy(zero_copy_only=False) for c in ("label", "_a", "_b", "n")), known


def _blend(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    return alpha * a + (1.0 - alpha) * b


def _cell(v: np.ndarray, low: float, high: float, depth: int) -> np.ndarray:
    """The place of a value among ``2 ** depth`` equal cells; a deeper cell begins with the bits of the one around it."""
    if not high > low:
        return np.zeros(len(v), np.int64)
    return np.minimum(((v - low) / (high - low) * 2.0 ** depth).astype(np.int64), (1 << depth) - 1)


def ends(pairs: DataFrame, alphas: Sequence[float]) -> tuple[list[tuple[float, float]], int] | None:
    """Lowest and highest blend of each alpha and the number of rows; none if a bound is not finite."""
    mixes = [F.lit(float(x)) * F.col("_a") + F.lit(1.0 - float(x)) * F.col("_b") for x in alphas]
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    row = pairs.agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"),
        *[f(m) for m in mixes for f in (F.min, F.max)],
    ).first()
    found = [(row[1 + 2 * i], row[2 + 2 * i]) for i in range(len(alphas))]
    if not row["n"] or not all(isfinite(x) for pair in found for x in pair):
        return None
    return found, row["n"]


def _cells(pairs: DataFrame, alphas, bounds, depth: int, bits: int, chosen: Mapping[int, np.ndarray]) -> pd.DataFrame:
    """``alpha_no, cell, c`` in order for the cells inside the chosen ones, which are ``bits`` shallower."""

    def run(batches):
        sums = [np.zeros(len(chosen[i]) << bits) for i in range(len(alphas))]
        for _, a, b, n, known in _read(batches):
            a, b, n = a[known], b[known], n[known]
            for i, x in enumerate(alphas):
                cell = _cell(_blend(a, b, x), *bounds[i], depth)
                parent = cell >> bits
                j = np.minimum(np.searchsorted(chosen[i], parent), len(chosen[i]) - 1)
                here = chosen[i][j] == parent
                at = (j << bits | (cell & ((1 << bits) - 1)))[here]
                sums[i] += np.bincount(at, n[here], len(sums[i]))
        for i, c in enumerate(sums):
            some = np.flatnonzero(c)
            cell = chosen[i][some >> bits] << bits | some & ((1 << bits) - 1)
            yield pa.RecordBatch.from_pydict(
                {"alpha_no": np.full(len(some), i, np.int32), "cell": cell.astype(np.int64), "c": c[some].astype(np.int64)})

    counts = pairs.mapInArrow(run, "alpha_no int, cell long, c long").groupBy("alpha_no", "cell").agg(F.sum("c").alias("c"))
    return counts.toPandas().sort_values(["alpha_no", "cell"])  # a bounded number of cells per alpha


def quantiles(pairs: DataFrame, alphas: Sequence[float], probs: Sequence[float]) -> dict[int, list[float]] | None:
    """Exact linear-interpolated quantiles of each blend, or none if cells cannot tell its values apart.

    The cells that hold a wanted rank are cut further in each pass, until few rows are left in them;
    only the values of these are sorted.
    """
    known = ends(pairs, alphas)
    if known is None:
        return None
    bounds, n = known
    ranks = sorted({f(p * (n - 1)) for p in probs for f in (floor, ceil)})
    place = {(i, r): (0, r) for i in range(len(alphas)) for r in ranks}  # cell, rank inside it
    depth = bits = FIRST
    left = n * len(alphas)
    while True:
        chosen = {i: np.array(sorted({place[i, r][0] for r in ranks}), np.int64) for i in range(len(alphas))}
        found = _cells(pairs, alphas, bounds, depth, bits, chosen)
        held = {}
        for i, cells in found.groupby("alpha_no"):
            cell, c = cells["cell"].to_numpy(), cells["c"].to_numpy()
            upto = np.concatenate([[0], np.cumsum(c)])
            for r in ranks:
                parent, k = place[i, r]
                at = upto[np.searchsorted(cell, parent << bits)] + k
                j = int(np.searchsorted(upto, at, side="right")) - 1
                place[i, r] = int(cell[j]), int(at - upto[j])
                held[i, int(cell[j])] = int(c[j])
        before, left = left, sum(held.values())
        if left <= CANDIDATES or left > before / 2 or depth + FURTHER > DEEPEST:
            break
        depth, bits = depth + FURTHER, FURTHER
    chosen = {i: np.array(sorted({place[i, r][0] for r in ranks}), np.int64) for i in range(len(alphas))}

    def values(batches):
        for _, a, b, weight, some in _read(batches):
            for i, x in enumerate(alphas):
                v = _blend(a[some], b[some], x)
                cell = _cell(v, *bounds[i], depth)
                here = np.isin(cell, chosen[i])
                v, at = np.unique(v[here], return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "alpha_no": np.full(len(v), i, np.int32), "cell": _cell(v, *bounds[i], depth), "v": v,
                    "c": np.bincount(at, weight[some][here], len(v)).astype(np.int64)})

    kinds = "alpha_no int, cell long, v double, c long"
    different = checkpointed(pairs.mapInArrow(values, kinds).groupBy("alpha_no", "cell", "v").agg(F.sum("c").alias("c")))
    if different.count() > SORTED:
        return None
    upto = F.sum("c").over(Window.partitionBy("alpha_no", "cell").orderBy("v"))
    wanted = pairs.sparkSession.createDataFrame(
        [(i, r, cell, k) for (i, r), (cell, k) in place.items()], "alpha_no int, r long, cell long, k long")
    hits = different.withColumn("upto", upto).join(F.broadcast(wanted), ["alpha_no", "cell"]).filter(
        "upto - c <= k and k < upto").select("alpha_no", "r", "v").collect()
    value = {(h["alpha_no"], h["r"]): h["v"] for h in hits}

    def between(i: int, at: float) -> float:
        a, b = value[i, floor(at)], value[i, ceil(at)]
        return a + (b - a) * (at - floor(at))

    return {i: [between(i, p * (n - 1)) for p in probs] for i in range(len(alphas))}


def passed(pairs: DataFrame, alphas: Sequence[float], grids: Mapping[int, Sequence[float]], strict: bool) -> DataFrame:
    """``alpha_no, b, pos, neg``: rows by how many values of the alpha's grid (rising) their blend passes."""
    tables = {i: np.array(g, dtype=float) for i, g in grids.items()}

    def run(batches):
        sums = {i: np.zeros((2, len(g) + 1)) for i, g in tables.items()}
        for label, a, b, n, known in _read(batches):
            for i, g in tables.items():
                at = np.where(known, np.searchsorted(g, _blend(a, b, alphas[i]), side="left" if strict else "right"), 0)
                for row, value in enumerate((1, 0)):
                    mine = label == value
                    sums[i][row] += np.bincount(at[mine], n[mine], len(g) + 1)
        for i, (pos, neg) in sums.items():
            some = np.flatnonzero(pos + neg)
            yield pa.RecordBatch.from_pydict({
                "alpha_no": np.full(len(some), i, np.int32), "b": some.astype(np.int32),
                "pos": pos[some].astype(np.int64), "neg": neg[some].astype(np.int64)})

    counts = pairs.mapInArrow(run, "alpha_no int, b int, pos long, neg long")
    return counts.groupBy("alpha_no", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _area(part: pd.DataFrame) -> tuple[int, int, float]:
    """Positives, negatives and the area inside one stretch of values."""
    v, w = ({k: [np.frombuffer(x) for x, label in zip(part[c], part["label"]) if label == k] for k in (0, 1)} for c in ("v", "w"))
    pos_v, neg_v = (np.concatenate(v[k] or [np.zeros(0)]) for k in (1, 0))
    pos_w, neg_w = (np.concatenate(w[k] or [np.zeros(0)]) for k in (1, 0))
    order = np.argsort(pos_v)
    pos_v, below = pos_v[order], np.concatenate([[0.0], np.cumsum(pos_w[order])])
    # A positive above a negative counts once, at the same value half.
    upto, under = below[np.searchsorted(pos_v, neg_v, "right")], below[np.searchsorted(pos_v, neg_v, "left")]
    return int(below[-1]), int(neg_w.sum()), float((neg_w * (below[-1] - (upto + under) / 2)).sum())


def auroc(pairs: DataFrame, alphas: Sequence[float]) -> DataFrame | None:
    """``alpha_no, auroc`` with ties counted half and unknown blends lowest, or none if cells cannot tell the blends apart.

    The blends move as blocks of doubles to the task that sorts their stretch of values; the pairs
    of different stretches follow from their counts.
    """
    known = ends(pairs, alphas)
    if known is None:
        return None
    bounds, _ = known
    rows = pairs.withColumn("n", F.lit(1).cast("long"))
    found = _cells(rows, alphas, bounds, FIRST, FIRST, {i: np.zeros(1, np.int64) for i in range(len(alphas))})
    if found["c"].max() > 4 * PART_ROWS:
        return None
    cuts = {}  # first cells of the second, third ... stretch
    for i, cells in found.groupby("alpha_no"):
        stretch = (np.cumsum(cells["c"].to_numpy()) - 1) // PART_ROWS
        first = np.flatnonzero(np.diff(stretch)) + 1
        cuts[i] = cells["cell"].to_numpy()[first]

    def blocks(batches):
        def moved(some):
            label, a, b, n, known = (np.concatenate(x) for x in zip(*some))
            for i, x in enumerate(alphas):
                v = np.where(known, _blend(a, b, x), bounds[i][0])
                part = np.searchsorted(cuts[i], _cell(v, *bounds[i], FIRST), side="right")
                v[~known] = -np.inf  # unknown blends are one value below all others
                for value in (0, 1):
                    mine = np.flatnonzero(label == value)
                    mine = mine[np.argsort(part[mine], kind="stable")]
                    at = np.searchsorted(part[mine], np.arange(len(cuts[i]) + 2))
                    for p, (start, end) in enumerate(zip(at, at[1:])):
                        if end > start:
                            yield i, p, value, v[mine[start:end]].tobytes(), n[mine[start:end]].astype(float).tobytes()

        names, kinds = ("alpha_no", "part", "label", "v", "w"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

        def written(some):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*moved(some)), kinds)], names)

        held, size = [], 0
        for columns in _read(batches):
            held.append(columns)
            size += len(columns[0])
            if size >= BLOCK_ROWS:
                yield written(held)
                held, size = [], 0
        if size:
            yield written(held)

    def areas(key, part):
        return pd.DataFrame([(*key, *_area(part))], columns=["alpha_no", "part", "pos", "neg", "area"])

    kinds = "alpha_no int, part int, label int, v binary, w binary"
    done = pairs.mapInArrow(blocks, kinds).groupBy("alpha_no", "part").applyInPandas(
        areas, "alpha_no int, part int, pos long, neg long, area double")
    above = Window.partitionBy("alpha_no").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    done = done.withColumn("above", F.coalesce(F.sum("pos").over(above), F.lit(0)))
    both = (F.sum("pos") * F.sum("neg")).cast("double")
    return done.groupBy("alpha_no").agg(
        F.when(both > 0, F.sum(F.col("area") + F.col("neg") * F.col("above")) / both).otherwise(0.0).alias("auroc"))
