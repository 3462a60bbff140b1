"""Alert grouping, alert fatigue and priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omenlog.operators.classify import ratio
from omenlog.operators.order import Order, first_at_or_after, laid_out, quantiles, running
from omenlog.schema import SECOND
from omenlog.session import checkpointed


def priority(max_score: Column, tp_ratio: Column | None = None) -> Column:
    """critical / high / medium / low; without labels only the score decides."""
    if tp_ratio is None:
        return (
            F.when(max_score > 10, "critical").when(max_score > 8, "high")
            .when(max_score > 6, "medium").otherwise("low")
        )
    return (
        F.when((max_score > 10) & (tp_ratio > 0.8), "critical")
        .when((max_score > 8) | (tp_ratio > 0.6), "high")
        .when((max_score > 6) | (tp_ratio > 0.4), "medium")
        .otherwise("low")
    )


def rank_of(name: Column) -> Column:
    """0 for critical up to 3 for low."""
    return (
        F.when(name == "critical", 0).when(name == "high", 1).when(name == "medium", 2).otherwise(3)
    )


def group_starts(
    instants: DataFrame, width_us: int, *, keys: Sequence[str] = (), order: Order | None = None,
) -> DataFrame:
    """Start instants of anchored windows over distinct ``(keys, us)``.

    A group opens at its first alert and takes everything up to ``start + width``.
    A gap above the width always opens a group, so the stream falls into independent
    pieces there.  Every instant points at the first instant after ``us + width`` of its
    piece; from the heads of the pieces the pointers are followed and doubled until no
    new start appears (log2 of the most groups in a piece).
    """
    keys = tuple(keys)
    order = order or Order(keys, ("us",))
    gapped = running(laid_out(instants, order), order, {"prev": ("max", F.col("us"))}, exclusive=True)
    head = F.col("prev").isNull() | (F.col("us") - F.col("prev") > width_us)
    flagged = checkpointed(gapped.select(*keys, "us", head.alias("head")))
    probes = flagged.select(*keys, "us", (F.col("us") + width_us + 1).alias("at"))
    marks = flagged.select(*keys, F.col("us").alias("at"), "head")
    jumps = first_at_or_after(probes, marks, {"next": F.struct("at", "head")}, keys=keys, ranges=order.ranges)
    jumps = checkpointed(jumps.filter("not next.head").select(*keys, "us", F.col("next.at").alias("next")))
    starts = checkpointed(flagged.filter("head").select(*keys, "us"))
    known = starts.count()
    while True:
        reached = starts.join(jumps, [*keys, "us"]).select(*keys, F.col("next").alias("us"))
        starts = checkpointed(starts.union(reached).distinct())
        grown = starts.count()
        if grown == known:
            return starts
        known = grown
        further = jumps.select(*keys, F.col("us").alias("next"), F.col("next").alias("after"))
        jumps = checkpointed(
            jumps.join(further, [*keys, "next"]).select(*keys, "us", F.col("after").alias("next"))
        )


def anchored_groups(
    alerts: DataFrame,
    width_seconds: float,
    *,
    keys: Sequence[str] = (),
    min_score: float | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Alerts with the start of their group (``window_start``, epoch microseconds).

    The membership stays one row per alert: a hot group is never gathered.
    """
    keys = tuple(keys)
    width = int(width_seconds * SECOND)
    if min_score is not None:
        alerts = alerts.filter(F.col("score") >= min_score)
    base = Order(keys, ("us",), ranges)
    instants = laid_out(alerts.select(*keys, "us").distinct(), base)
    starts = group_starts(instants, width, keys=keys, order=base)
    flagged = instants.join(
        starts.withColumn("_start", F.col("us")), [*keys, "us"], "left"
    )
    assigned = running(flagged, base, {"window_start": ("last", F.col("_start"))}).drop("_start", base.range)
    return alerts.join(assigned, [*keys, "us"])


def group_summary(members: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: bounds, counts, scores, true/false positives, priority."""
    hits = F.count_if(F.col("label") == 1)
    groups = members.groupBy(*keys, "window_start").agg(
        F.max("us").alias("window_end"),
        F.count("*").alias("alert_count"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
        F.min("line_id").alias("first_line"),
        F.max("line_id").alias("last_line"),
        hits.alias("tp"),
        (F.count("*") - hits).alias("fp"),
    )
    return groups.withColumn(
        "priority", priority(F.col("max_score"), F.col("tp") / F.col("alert_count"))
    )


def group_metrics(groups: DataFrame) -> DataFrame:
    """Totals, reduction and the priority distribution as one row."""
    row = groups.agg(
        F.coalesce(F.sum("alert_count"), F.lit(0)).alias("total_alerts"),
        F.count("*").alias("total_groups"),
        *[F.count_if(F.col("priority") == p).alias(p) for p in ("critical", "high", "medium", "low")],
    )
    a, g = F.col("total_alerts"), F.col("total_groups")
    return row.withColumns({
        "reduction_pct": F.when(a > 0, (1 - g / a) * 100).otherwise(0.0),
        "avg_per_group": ratio(a, g),
    })


def top_groups(groups: DataFrame, n: int = 10) -> DataFrame:
    """Most urgent groups: priority first, then highest score, then earliest."""
    return groups.orderBy(
        rank_of(F.col("priority")), F.col("max_score").desc(), F.col("window_start")
    ).limit(n)


def sliding_volume(alerts: DataFrame, width: str, slide: str) -> DataFrame:
    """Alerts per overlapping window."""
    return alerts.groupBy(F.window("ts", width, slide).alias("w")).agg(
        F.count("*").alias("alert_count"),
        F.max("score").alias("max_score"),
        F.count_if(F.col("label") == 1).alias("tp"),
    ).select(F.unix_micros("w.start").alias("window_start"), "alert_count", "max_score", "tp")


def window_counts(df: DataFrame, alert: Column, width: str) -> DataFrame:
    """Alerts and failures per tumbling window (windows without rows do not exist)."""
    return df.groupBy(F.window("ts", width).alias("w")).agg(
        F.count_if(alert == 1).alias("alerts"), F.count_if(F.col("label") == 1).alias("failures")
    ).select(F.unix_micros("w.start").alias("window_start"), "alerts", "failures")


def window_precision(df: DataFrame, alert: Column, width: str, *wider: str) -> DataFrame:
    """How many alerting windows hold a failure, one row for each width.

    The rows are counted once, in windows of ``width``; ``wider`` widths, whole multiples of
    it, are summed up from those counts.
    """
    finest = checkpointed(window_counts(df, alert, width))
    out = _precision(finest, width)
    for w in wider:
        sums = finest.groupBy(F.window(F.timestamp_micros("window_start"), w).alias("w")).agg(
            F.sum("alerts").alias("alerts"), F.sum("failures").alias("failures"))
        out = out.unionByName(_precision(sums, w))
    return out


def _precision(w: DataFrame, width: str) -> DataFrame:
    """One row from the counts of windows of one width."""
    alerting = F.col("alerts") > 0
    false_alarm = alerting & (F.col("failures") == 0)
    row = w.agg(
        F.count("*").alias("total_windows"),
        F.count_if(alerting).alias("alert_windows"),
        F.count_if(F.col("failures") > 0).alias("failure_windows"),
        F.count_if(false_alarm).alias("false_alarm_windows"),
        F.coalesce(F.avg(F.when(alerting, F.col("alerts"))), F.lit(0.0)).alias("avg_alerts"),
        F.coalesce(F.max(F.when(alerting, F.col("alerts"))), F.lit(0)).alias("max_alerts"),
    )
    n, bad = F.col("alert_windows"), F.col("false_alarm_windows")
    return row.select(
        F.lit(width).alias("window_size"), "*",
        ratio(n - bad, n).alias("precision_in_windows"),
        ratio(bad, n).alias("false_alarm_rate"),
    )


def concentration(
    df: DataFrame, alert: Column, *, order: Order | None = None
) -> DataFrame:
    """Gaps between consecutive alerts: mean, median, min, max and variation, one row."""
    alerts = df.filter(alert == 1).select("line_id", "us")
    order = order or Order()
    gaps = running(alerts, order, {"prev": ("last", F.col("us"))}, exclusive=True).select(
        ((F.col("us") - F.col("prev")) / F.lit(float(SECOND))).alias("gap")
    )
    median = quantiles(gaps, F.col("gap"), [0.5]).select("value").scalar()
    row = gaps.agg(
        F.count("*").alias("total_alerts"),
        F.avg("gap").alias("avg_gap"),
        F.stddev_pop("gap").alias("std_gap"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
    )
    return row.select(
        "total_alerts",
        F.when(F.col("avg_gap") > 0, F.col("std_gap") / F.col("avg_gap")).otherwise(0.0).alias("concentration"),
        F.coalesce("avg_gap", F.lit(0.0)).alias("avg_gap"),
        median.alias("median_gap"), "min_gap", "max_gap",
    )
