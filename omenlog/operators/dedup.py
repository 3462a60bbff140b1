"""Score every distinct line once and look the result up for all its copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.session import checkpointed


def distinct_lines(df: DataFrame, text: str = "norm") -> DataFrame:
    """Distinct texts with their first line and number of copies."""
    return df.groupBy(text).agg(F.min("line_id").alias("first_line"), F.count("*").alias("copies"))


def dedup_ratio(df: DataFrame, text: str = "norm", *, approximate: bool = False) -> DataFrame:
    """Lines, distinct lines and the share of scoring saved."""
    if approximate:
        row = df.agg(F.count(text).alias("lines"), F.approx_count_distinct(text).alias("distinct_lines"))
    else:
        row = df.groupBy(text).agg(F.count(text).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count(text).alias("distinct_lines")
        )
    share = 1 - F.col("distinct_lines") / F.greatest(F.col("lines"), F.lit(1))
    return row.withColumn("saved", share)


def score_once(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], *, text: str = "norm", how: str = "inner",
) -> DataFrame:
    """Apply ``score`` to the distinct texts and give every line the result of its text.

    The lines are written first, so whatever made their text runs once.  The join meets one row
    per text; adaptive execution splits the lines of a hot text over tasks.
    """
    df = checkpointed(df)
    return df.join(score(df.select(text).distinct()), text, how)
