"""Watermarked aggregations over a stream of scored lines (``ts, us, score, label`` ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.classify import flag


def timely(condition: Column, ts: str = "ts") -> Column:
    """A filter that stays behind the watermark, so that the rows it drops move the watermark too.

    Filters that do not read the event time are pushed below the watermark by the optimizer.
    """
    return F.when(F.col(ts).isNotNull(), condition)


def tumbling_alerts(stream: DataFrame, threshold: float, width: str, late: str) -> DataFrame:
    """Alerts and failures per tumbling window, emitted once the watermark has passed it."""
    hit = flag(F.col("score"), threshold) == 1
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.count_if(hit).alias("alerts"), F.count_if(F.col("label") == 1).alias("failures"))
        .select(F.unix_micros("w.start").alias("window_start"), "alerts", "failures")
    )


def sliding_alerts(stream: DataFrame, threshold: float, width: str, slide: str, late: str) -> DataFrame:
    """Alert volume per overlapping window."""
    return (
        stream.withWatermark("ts", late)
        .filter(timely(F.col("score") > threshold))
        .groupBy(F.window("ts", width, slide).alias("w"))
        .agg(F.count("*").alias("alert_count"), F.max("score").alias("max_score"))
        .select(F.unix_micros("w.start").alias("window_start"), "alert_count", "max_score")
    )


def alert_sessions(stream: DataFrame, threshold: float, gap: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Alerts of a key with no gap above ``gap`` between neighbours."""
    return (
        stream.withWatermark("ts", late)
        .filter(timely(F.col("score") > threshold))
        .groupBy(*keys, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("alert_count"), F.max("score").alias("max_score"))
        .select(*keys, F.unix_micros("w.start").alias("session_start"), "alert_count", "max_score")
    )


def first_copies(stream: DataFrame, on: Sequence[str | Column], late: str) -> DataFrame:
    """The first copy of identical lines; their state is dropped after the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(on))
