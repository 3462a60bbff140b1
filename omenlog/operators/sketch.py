"""Approximate quantiles from mergeable sketches that are kept per day.

The exact quantiles of ``order.quantiles`` sort all values.  Here each day is summed up once by a
KLL sketch of a few kilobytes; thresholds over any days come from merging the kept sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of the sketches.
K = 1024


def rank_error(k: int = K) -> float:
    """The error in rank, as a share of the rows, that a quantile of the sketch keeps with 99 % confidence."""
    return 2.296 / k**0.9723


def daily(df: DataFrame, value: Column, day: Column, *, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """``day, keys, sketch`` (binary).  Tasks sketch before the shuffle, so a hot day moves a few sketches.

    Null and NaN values are left out; a day without values has no sketch.
    """
    rows = df.select(day.cast("date").alias("day"), *keys, value.cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy("day", *keys).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def keep_days(sketches: DataFrame, folder: str) -> None:
    """Write the sketches of some days below ``folder``; a day written again replaces its old sketches."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def kept_days(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches kept below ``folder``; filters on ``day`` read only those days."""
    return spark.read.parquet(folder)


def quantiles(sketches: DataFrame, probs: Sequence[float], *, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """``keys, n, q`` (index into ``probs``) and ``value`` from the merged sketches; no row for no sketches."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    n = F.kll_sketch_get_n_double("_s")
    found = F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))) for p in probs])
    return merged.filter(n > 0).select(*keys, n.alias("n"), F.posexplode(found).alias("q", "value"))
