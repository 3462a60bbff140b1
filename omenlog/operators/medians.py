"""Medians over the last rows of an order, kept by an indexed tree instead of sorted frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omenlog.operators.order import Order, blocks

BLOCK_ROWS = 65_536


class RankTree:
    """Counts of the present ranks 1..n, summed in a tree: add, drop and k-th in log2(n) steps."""

    def __init__(self, n: int):
        self.n, self.top = n, 1 << max(0, n.bit_length() - 1)
        self.sums = [0] * (n + 1)

    def add(self, rank: int, count: int = 1) -> None:
        sums, n = self.sums, self.n
        while rank <= n:
            sums[rank] += count
            rank += rank & -rank

    def kth(self, k: int) -> int:
        """The k-th smallest present rank (k from 1)."""
        sums, n, step, at = self.sums, self.n, self.top, 0
        while step:
            ahead = at + step
            if ahead <= n and sums[ahead] < k:
                at, k = ahead, k - sums[ahead]
            step >>= 1
        return at + 1


def running_median(values: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Median of the known values in rows ``first[i]..i`` for each row; NaN where there are none.

    ``first`` never decreases.  NaN counts as the largest value, as Spark sorts it.
    """
    order = np.argsort(np.where(known, values, np.nan), kind="stable")
    ranks = np.empty(len(values), dtype=np.int64)
    ranks[order] = np.arange(1, len(values) + 1)
    by_rank, rank_of, there = values[order].tolist(), ranks.tolist(), known.tolist()
    tree, out, left, size = RankTree(len(values)), np.full(len(values), np.nan), 0, 0
    for i, start in enumerate(first.tolist()):
        if there[i]:
            tree.add(rank_of[i])
            size += 1
        while left < start:
            if there[left]:
                tree.add(rank_of[left], -1)
                size -= 1
            left += 1
        if size:
            low = by_rank[tree.kth((size + 1) // 2) - 1]
            out[i] = low if size % 2 else 0.5 * low + 0.5 * by_rank[tree.kth(size // 2 + 1) - 1]
    return out


def with_median(
    df: DataFrame, window: int, *, order: Order, value: str = "score", size: str = "_n", median: str = "_base",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with the number of rows and the median of ``value`` over the last ``window`` rows of the key.

    A row costs log2(block) steps whatever the window.  A task sees a block and the ``window - 1``
    rows before it.  Null values are left out; the median of nulls alone is null; an empty table
    gives an empty one.
    """
    laid = blocks(df, order, window - 1, block_rows)
    helpers = [c for c in laid.columns if c in ("_ord", "_pos", "_block", "_own")]
    kept = [f for f in laid.schema.fields if f.name not in helpers]
    schema = T.StructType([*kept, T.StructField(size, T.LongType()), T.StructField(median, T.DoubleType())])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_ord")
        own = np.flatnonzero(block["_own"].to_numpy())
        column = block[value].cast(pa.float64())
        known = column.is_valid().to_numpy()
        values = column.fill_null(0.0).to_numpy()
        rows = np.minimum(block["_pos"].to_numpy() + 1, window)
        first = np.maximum.accumulate(np.maximum(np.arange(len(rows)) - rows + 1, 0))
        found = running_median(values, known, first)[own]
        any_known = np.concatenate([[0], np.cumsum(known)])
        none = (any_known[own + 1] - any_known[first[own]]) == 0
        mine = block.take(pa.array(own)).select([f.name for f in kept])
        return mine.append_column(size, pa.array(rows[own], pa.int64())).append_column(
            median, pa.array(found, pa.float64(), mask=none))

    return laid.groupBy("_block").applyInArrow(run, schema)
