"""Helpers of the vector operators: valid rows as a written table, and matrices of a block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omenlog.session import checkpointed

#: A row is a query if its id is divisible by this.
EVERY = 20


def valid(vectors: DataFrame, id_col: str, vector_col: str, component: Column | None = None) -> DataFrame:
    """``row, vec_id, v``: rows with an id and a vector without null or non-finite components.

    ``row`` tells repeated rows apart; it is fixed because the table is written.
    """
    x = F.transform(vector_col, lambda c: c.cast("double"))
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    if component is not None:
        rows = rows.withColumn("v", component)
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def matrix(lists: pd.Series, width: int, dtype=np.float64) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    if all(len(x) == width for x in lists):
        return np.stack([np.asarray(x, dtype=dtype) for x in lists]) if len(lists) else np.zeros((0, width), dtype)
    out = np.zeros((len(lists), width), dtype)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query (``query, score, vec_id, row``), ranked from 1."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
