"""Timestamp audit: order, gaps, duplicates, coverage, frequency, failures, verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.order import Order, quantile_list, quantiles, running
from omenlog.operators.temporal import side_by_side
from omenlog.schema import SECOND
from omenlog.session import checkpointed

ARRIVAL = Order((), ("line_id",))


def gaps_of(df: DataFrame, order: Order = ARRIVAL) -> DataFrame:
    """Every row with its predecessor, written once: ``line_id, us, prev_line, gap`` (seconds).

    The audits below take it as ``gaps``, so that one ordered scan serves all of them.
    """
    out = running(
        df.select("line_id", "us"), order,
        {"_prev": ("last", F.struct("us", "line_id"))}, exclusive=True,
    )
    return checkpointed(out.select(
        "line_id", "us", F.col("_prev.line_id").alias("prev_line"),
        ((F.col("us") - F.col("_prev.us")) / F.lit(float(SECOND))).alias("gap"),
    ))


def _or(gaps: DataFrame | None, df: DataFrame, order: Order) -> DataFrame:
    return gaps_of(df, order) if gaps is None else gaps


def monotonicity(df: DataFrame, *, order: Order = ARRIVAL, gaps: DataFrame | None = None) -> DataFrame:
    """Order violations in arrival order and the first row followed by an earlier time."""
    back = F.col("gap") < 0
    return _or(gaps, df, order).agg(
        F.count_if(back).alias("violations"),
        F.min(F.when(back, F.col("prev_line"))).alias("first_violation"),
    ).withColumn("is_monotonic", (F.col("violations") == 0).cast("int"))


def gap_audit(df: DataFrame, *, order: Order = ARRIVAL, gaps: DataFrame | None = None) -> DataFrame:
    """Gap statistics and the zero, extreme (> 100 x median positive gap) and negative gaps."""
    gaps = _or(gaps, df, order).filter("gap is not null")
    g = F.col("gap")
    # All gaps and the positive ones in one ordered scan; six numbers come to the driver.
    parts = F.array(F.struct(F.lit(0).alias("part"), g.alias("v")), F.struct(F.lit(1).alias("part"), F.when(g > 0, g).alias("v")))
    points = quantiles(gaps.select(F.explode(parts).alias("p")).select("p.*"), F.col("v"), [0.5, 0.95, 0.99], keys=("part",))
    found = {(r["part"], r["q"]): r["value"] for r in points.collect()}
    median, p95, p99 = (found.get((0, q)) for q in range(3))
    typical = found.get((1, 0), 1.0)
    row = gaps.agg(
        F.count("*").alias("gaps"), F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"),
        F.min(g).alias("min"), F.max(g).alias("max"),
        F.count_if(g == 0).alias("zero_gaps"),
        F.count_if(g > typical * 100).alias("extreme_gaps"),
        F.count_if(g < 0).alias("negative_gaps"),
    )
    return row.withColumns({
        "median": F.lit(median).cast("double"), "p95": F.lit(p95).cast("double"),
        "p99": F.lit(p99).cast("double"),
        "zero_gap_pct": F.when(F.col("gaps") > 0, F.col("zero_gaps") / F.col("gaps") * 100),
    })


def duplicates(df: DataFrame) -> DataFrame:
    """Rows whose time was seen before, and the number of distinct times."""
    times = df.groupBy("us").agg(F.count("*").alias("n"))
    return times.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("num_duplicates"),
        F.coalesce(F.sum(F.col("n") - 1) / F.sum("n") * 100, F.lit(0.0)).alias("duplicate_pct"),
        F.count("*").alias("unique_timestamps"),
    )


def coverage(df: DataFrame) -> DataFrame:
    """Time span and event rates."""
    row = df.agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("total_events"))
    span = (F.col("end_us") - F.col("start_us")) / F.lit(float(SECOND))
    per_second = F.when(span > 0, F.col("total_events") / span).otherwise(0.0)
    return row.withColumns({
        "span_hours": span / 3600, "per_second": per_second,
        "per_minute": per_second * 60, "per_hour": per_second * 3600,
    })


def frequency(df: DataFrame) -> DataFrame:
    """Variation of the hourly and week-day counts (sample std) with peak and quiet slots."""
    cells = df.groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("day")).count()

    def part(slot: str, name: str) -> DataFrame:
        counts = cells.groupBy(slot).agg(F.sum("count").alias("n"))
        cv = F.stddev_samp("n") / F.avg("n")
        return counts.agg(
            F.coalesce(cv, F.lit(0.0)).alias(f"{name}_cv"),
            F.max_by(slot, F.struct(F.col("n"), -F.col(slot))).alias(f"{name}_peak"),
            F.min_by(slot, F.struct(F.col("n"), F.col(slot))).alias(f"{name}_quiet"),
            F.max("n").alias(f"{name}_peak_count"), F.min("n").alias(f"{name}_quiet_count"),
        )

    return side_by_side(part("hour", "hour"), part("day", "day"))


def gap_outliers(
    df: DataFrame, *, order: Order = ARRIVAL, least: int = 10, gaps: DataFrame | None = None
) -> DataFrame:
    """Gaps outside ``[q1 - 3 iqr, q3 + 3 iqr]``; null counts with fewer than ``least`` gaps."""
    gaps = _or(gaps, df, order).filter("gap is not null")
    q1, q3 = quantile_list(gaps, F.col("gap"), [0.25, 0.75]) or [0.0, 0.0]
    iqr = q3 - q1
    low, high = q1 - 3 * iqr, q3 + 3 * iqr
    row = gaps.agg(
        F.count("*").alias("gaps"),
        F.count_if(F.col("gap") < low).alias("outliers_low"),
        F.count_if(F.col("gap") > high).alias("outliers_high"),
    )
    enough = F.col("gaps") >= least
    total = F.col("outliers_low") + F.col("outliers_high")
    return row.select(
        "gaps",
        F.when(enough, F.col("outliers_low")).alias("outliers_low"),
        F.when(enough, F.col("outliers_high")).alias("outliers_high"),
        F.when(enough, total).alias("outliers"),
        F.when(enough, total / F.col("gaps") * 100).alias("outliers_pct"),
        F.lit(iqr).alias("iqr"), F.lit(low).alias("lower"), F.lit(high).alias("upper"),
    )


def failure_audit(df: DataFrame, *, order: Order = ARRIVAL) -> DataFrame:
    """Gaps between consecutive failures and the failure rate."""
    failed = df.filter("label = 1")
    gaps = gaps_of(failed, order)
    median = (quantile_list(gaps, F.col("gap"), [0.5]) or [None])[0]
    row = gaps.agg(
        F.count("*").alias("num_failures"), F.avg("gap").alias("mean"),
        F.min("gap").alias("min"), F.max("gap").alias("max"),
    ).withColumn("median", F.lit(median).cast("double"))
    total = df.agg(F.count("*").alias("n")).scalar()
    return row.withColumn("failure_rate", F.col("num_failures") / total)


def failure_calendar(df: DataFrame) -> DataFrame:
    """Failures per hour of day and per week day."""
    slots = F.array(
        F.struct(F.lit("hour").alias("unit"), F.hour("ts").alias("slot")),
        F.struct(F.lit("weekday").alias("unit"), F.weekday("ts").alias("slot")),
    )
    return df.filter("label = 1").select(F.explode(slots).alias("s")).groupBy("s.unit", "s.slot").agg(
        F.count("*").alias("failures")
    )


def issues(df: DataFrame, *, order: Order = ARRIVAL) -> DataFrame:
    """Rows ``severity, type, measure`` for every finding."""
    gaps = gaps_of(df, order)
    facts = side_by_side(
        monotonicity(df, gaps=gaps).select("violations"),
        gap_audit(df, gaps=gaps).select("zero_gap_pct", "extreme_gaps", "negative_gaps"),
        duplicates(df).select("duplicate_pct"),
        coverage(df).select("span_hours"),
        gap_outliers(df, gaps=gaps).select("outliers_pct"),
        failure_audit(df, order=order).select(F.col("min").alias("failure_gap")),
    )
    # The limits above which a finding is reported.
    rules: Sequence[tuple[str, str, Column, Column]] = (
        ("critical", "non_monotonic", F.col("violations") > 0, F.col("violations")),
        ("warning", "excessive_zero_gaps", F.col("zero_gap_pct") > 10, F.col("zero_gap_pct")),
        ("warning", "extreme_gaps", F.col("extreme_gaps") > 0, F.col("extreme_gaps")),
        ("critical", "negative_gaps", F.col("negative_gaps") > 0, F.col("negative_gaps")),
        ("warning", "high_duplicate_rate", F.col("duplicate_pct") > 5, F.col("duplicate_pct")),
        ("warning", "short_time_span", F.col("span_hours") < 60 / 3600, F.col("span_hours")),
        ("warning", "high_outlier_rate", F.col("outliers_pct") > 5, F.col("outliers_pct")),
        ("warning", "failures_too_close", F.col("failure_gap") < 1.0, F.col("failure_gap")),
    )
    found = F.array(*[
        F.struct(F.lit(s).alias("severity"), F.lit(t).alias("type"),
                 hit.alias("hit"), measure.cast("double").alias("measure"))
        for s, t, hit, measure in rules
    ])
    return facts.select(F.explode(found).alias("i")).filter("i.hit").select("i.severity", "i.type", "i.measure")


def verdict(found: DataFrame) -> DataFrame:
    """FAILED with a critical finding, else WARNING with any, else PASSED."""
    row = found.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    status = F.when(F.col("critical") > 0, "FAILED").when(F.col("warnings") > 0, "WARNING").otherwise("PASSED")
    return row.withColumn("status", status)


def quick_check(df: DataFrame, *, order: Order = ARRIVAL) -> DataFrame:
    """Non-zero gap statistics, rows with the time of their predecessor, and the range."""
    gaps = gaps_of(df, order)
    g = F.when(F.col("gap") != 0, F.col("gap"))
    names = ("p25", "p50", "p75", "p90", "p95", "p99")
    points = quantile_list(gaps, g, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) or [None] * 6
    return gaps.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("gap") == 0).alias("same_as_previous"),
        F.avg(g).alias("mean"), F.min(g).alias("min"), F.max(g).alias("max"),
        ((F.max("us") - F.min("us")) / F.lit(float(SECOND))).alias("range_seconds"),
    ).withColumns({n: F.lit(v).cast("double") for n, v in zip(names, points)})
