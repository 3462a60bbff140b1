"""Canonical column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000  # microseconds


def micros(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def scored(
    df: DataFrame,
    *,
    line_id: str | Column,
    ts: str | Column,
    score: str | Column,
    label: Column,
    **extra: str | Column,
) -> DataFrame:
    """``line_id, ts, us, score, label`` plus any extra columns (session keys and the like)."""

    def col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        col(line_id).cast("long").alias("line_id"),
        col(ts).cast("timestamp").alias("ts"),
        micros(col(ts)).alias("us"),
        col(score).cast("double").alias("score"),
        label.cast("int").alias("label"),
        *[col(c).alias(n) for n, c in extra.items()],
    )


def split_lines(df: DataFrame, owner: str, text: str, *extra: str) -> DataFrame:
    """One row per line of ``text``; ``line_id`` orders lines by ``(owner, position)``.

    An owner beyond 33 bits would share its line ids with another one and is an error.
    """
    pieces = df.select(
        F.col(owner).cast("long").alias("owner"),
        *extra,
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "raw"),
    )
    line_id = F.shiftleft(F.col("owner"), 31) + F.col("line_no")
    fits = F.col("owner").isNull() | F.col("owner").between(-(1 << 32), (1 << 32) - 1)
    return pieces.withColumn(
        "line_id", F.when(fits, line_id).otherwise(F.raise_error(F.lit("owner has more than 33 bits")).cast("long"))
    )
