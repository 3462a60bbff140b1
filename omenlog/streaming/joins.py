"""Joins of two streams over a range of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.schema import SECOND
from omenlog.streaming.windows import timely


def failures_with_alerts(
    failures: DataFrame, alerts: DataFrame, threshold: float, seconds: int, late: str, *, keys: Sequence[str] = ("key",),
) -> DataFrame:
    """``keys, line_id, us, alert_us``: each failure with the alerts of its key in ``[us - seconds, us)``.

    Both arguments are streams of scored lines (the same lines, read twice).  They are joined on the
    key and the range of time; a failure without alerts comes once, with a null.  Each side keeps a
    row until the watermark shows that no partner can come any more: an alert for ``seconds``, a
    failure until all rows before it are there.  A null key has no alerts.
    """
    left = failures.withWatermark("ts", late).filter(timely(F.col("label") == 1)).select(
        *keys, "line_id", "us", F.col("ts").alias("failed"))
    right = alerts.withWatermark("ts", late).filter(timely(F.col("score") > threshold)).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("us").alias("alert_us"), F.col("ts").alias("alerted"))
    match = (F.col("alerted") < F.col("failed")) & (F.col("alerted") >= F.col("failed") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, match, "leftOuter").select(*keys, "line_id", "us", "alert_us")


def lead_times(found: DataFrame, *, keys: Sequence[str] = ("key",)) -> DataFrame:
    """``keys, line_id, us, alert_us, dlt``: the earliest alert of each failure, of what the stream has written."""
    first = found.groupBy(*keys, "line_id", "us").agg(F.min("alert_us").alias("alert_us"))
    return first.withColumn("dlt", F.coalesce((F.col("us") - F.col("alert_us")) / SECOND, F.lit(0.0)))
