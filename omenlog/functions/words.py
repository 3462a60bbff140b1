"""Words, their contexts, sub-word pieces and packing into windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<s>", "</s>"
PIECES = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def contexts(tokens: Column) -> Column:
    """For every word: ``word, left, right`` with boundary marks at both ends."""
    n = F.size(tokens)
    left = F.concat(F.array(F.lit(START)), F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))))
    right = F.concat(F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(END)))
    zipped = F.arrays_zip(tokens.alias("word"), left.alias("left"), right.alias("right"))
    return F.when(n > 0, F.transform(zipped, lambda z: F.struct(
        z["word"], z["left"], z["right"]
    )))


def pieces(word: Column) -> Column:
    """Letters, digits and single signs of a word, the unit of sub-word scoring."""
    return F.regexp_extract_all(word, F.lit(PIECES), F.lit(0))


def _packed(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Window number of every word of one text."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.zeros(len(sizes), dtype=np.int32)
    start = number = 0
    while start < len(sizes):
        end = int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1
        end = max(end, start + 1)
        out[start:end] = number
        start, number = end, number + 1
    return out


def pack(lengths: pd.Series, budget: pd.Series) -> pd.Series:
    """Window number of every word when words are packed greedily under a length budget.

    A word longer than the budget gets a window of its own.
    """
    return pd.Series([None if s is None else _packed(np.asarray(s), int(b)) for s, b in zip(lengths, budget)])


def windows(tokens: Column, budget: int, lengths: Column | None = None) -> Column:
    """Window numbers of the words; a word counts its sub-word pieces unless given.

    The texts of a batch stay two flat arrays, of sizes and of windows, in the Python workers.
    """
    if lengths is None:
        lengths = F.transform(tokens, lambda w: F.greatest(F.size(pieces(w)), F.lit(1)))

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        out = np.zeros(len(flat), dtype=np.int32)
        for a, b in zip(ends, ends[1:]):
            out[a:b] = _packed(flat[a:b], budget)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=lists.is_null())

    return F.arrow_udf(run, "array<int>")(lengths)
