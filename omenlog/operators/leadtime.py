"""Detection lead time: how long before a failure an alert was raised.

``lead_time`` has four readings of "the alert before the failure":

* ``last``    - the nearest earlier row with an alert, any distance back
* ``within``  - the earliest alert in ``[t - seconds, t)``
* ``rows``    - the earliest alert in the previous ``rows`` rows
* ``rows_raw`` - as ``rows``, but negative lead times are kept (detail reports)
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.classify import flag, ratio
from omenlog.operators.order import (
    Order,
    blocks,
    first_at_or_after,
    ordinal,
    quantiles,
    running,
)
from omenlog.operators.sweep import sweep
from omenlog.schema import SECOND
from omenlog.session import checkpointed

HORIZONS = (60, 300, 600, 1800, 3600, 21600)
# Upper bounds (seconds, inclusive) and names of the lead-time categories.
CATEGORIES = (
    (0, "reactive (0s)"),
    (60, "1s-1min"),
    (300, "1-5min"),
    (900, "5-15min"),
    (3600, "15-60min"),
    (21600, "1-6hour"),
    (None, "6hour+"),
)
# Names of the week days, Monday first.
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _seconds(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(float(SECOND))


def lead_time(
    df: DataFrame,
    threshold: float | Column,
    mode: str = "rows",
    *,
    keys: Sequence[str] = (),
    strict: bool | None = None,
    rows: int = 1000,
    seconds: int = 3600,
    order: Order | None = None,
) -> DataFrame:
    """One row per failure: ``keys, line_id, us, alert_us, dlt`` (seconds, 0 without alert)."""
    keys = tuple(keys)
    order = order or Order(keys)
    strict = (mode != "last") if strict is None else strict
    marked = df.withColumn("alert", flag(F.col("score"), threshold, strict=strict))
    fails = F.col("label") == 1
    alert_us = F.when(F.col("alert") == 1, F.col("us"))

    if mode == "last":
        found = running(
            marked.select(*keys, "line_id", "us", "label", "alert"), order,
            {"alert_us": ("last", alert_us)}, exclusive=True,
        ).filter(fails)
    elif mode == "within":
        probes = marked.filter(fails).select(
            *keys, "line_id", "us", (F.col("us") - seconds * SECOND).alias("at")
        )
        marks = marked.filter("alert = 1").select(*keys, F.col("us").alias("at"))
        found = first_at_or_after(
            probes, marks, {"alert_us": F.col("at")}, keys=keys, ranges=order.ranges
        ).withColumn("alert_us", F.when(F.col("alert_us") < F.col("us"), F.col("alert_us")))
    elif mode in ("rows", "rows_raw"):
        numbered = ordinal(marked.select(*keys, "line_id", "us", "label", "alert"), order)
        probes = numbered.filter(fails).select(
            *keys, "line_id", "us", "pos", (F.col("pos") - rows).alias("at")
        )
        marks = numbered.filter("alert = 1").select(*keys, F.col("pos").alias("at"), "us")
        found = first_at_or_after(
            probes, marks, {"hit": F.struct(F.col("at").alias("pos"), F.col("us"))},
            keys=keys, ranges=order.ranges,
        ).withColumn("alert_us", F.when(F.col("hit.pos") < F.col("pos"), F.col("hit.us")))
    else:
        raise ValueError(f"unknown lead-time mode: {mode}")

    dlt = F.coalesce(_seconds(F.col("us"), F.col("alert_us")), F.lit(0.0))
    if mode != "rows_raw":
        dlt = F.greatest(dlt, F.lit(0.0))
    return found.select(*keys, "line_id", "us", "alert_us", dlt.alias("dlt"))


def warning_rate(min_lead: float, dlt: Column | None = None) -> Column:
    """Percentage of failures with at least ``min_lead`` seconds of warning (0 if none)."""
    dlt = F.col("dlt") if dlt is None else dlt
    return F.coalesce(F.avg((dlt >= min_lead).cast("double")) * 100, F.lit(0.0))


def horizons(dlts: DataFrame, seconds: Sequence[int] = HORIZONS) -> DataFrame:
    """Count and percentage of failures warned at least that long before."""
    row = dlts.agg(
        F.array(*[
            F.struct(
                F.lit(s).alias("horizon"),
                F.count_if(F.col("dlt") >= s).alias("failures"),
                warning_rate(s).alias("percentage"),
            )
            for s in seconds
        ]).alias("h")
    )
    return row.select(F.explode("h").alias("h")).select("h.*")


def summary(dlts: DataFrame) -> DataFrame:
    """One row: count, mean, median, population std, min, max, share above 0, warning rates."""
    d = F.col("dlt")
    dlts = checkpointed(dlts)
    median = quantiles(dlts, d, [0.5]).select("value").scalar()
    return dlts.agg(
        F.count("*").alias("total_failures"),
        F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_dlt"),
        F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias("std_dlt"),
        F.coalesce(F.min(d), F.lit(0.0)).alias("min_dlt"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_dlt"),
        F.coalesce(F.avg((d > 0).cast("double")) * 100, F.lit(0.0)).alias("positive_pct"),
        warning_rate(300).alias("ewr_5min"),
        warning_rate(900).alias("ewr_15min"),
        warning_rate(3600).alias("ewr_1hour"),
    ).withColumn("median_dlt", F.coalesce(median, F.lit(0.0)))


def category(dlt: Column) -> Column:
    """Name of the lead-time range (right-closed)."""
    picked = F.when(dlt == 0, CATEGORIES[0][1])
    for upper, name in CATEGORIES[1:-1]:
        picked = picked.when(dlt <= upper, name)
    return picked.otherwise(CATEGORIES[-1][1])


def categories(dlts: DataFrame) -> DataFrame:
    """Failures per lead-time range, empty ranges included."""
    counts = dlts.groupBy(category(F.greatest(F.col("dlt"), F.lit(0.0))).alias("category")).count()
    names = dlts.sparkSession.createDataFrame(
        [(i, name) for i, (_, name) in enumerate(CATEGORIES)], "rank int, category string"
    )
    return names.join(F.broadcast(counts), "category", "left").select(
        "rank", "category", F.coalesce("count", F.lit(0)).alias("failures")
    )


def percentiles(dlts: DataFrame, percents: Sequence[int] = (50, 75, 90, 95, 99)) -> DataFrame:
    """Percentiles of the positive lead times; 0 when there are none."""
    positive = dlts.filter("dlt > 0")
    found = quantiles(positive, F.col("dlt"), [p / 100 for p in percents])
    names = dlts.sparkSession.createDataFrame(list(enumerate(percents)), "q int, percentile int")
    return names.join(F.broadcast(found), "q", "left").select(
        "percentile", F.coalesce("value", F.lit(0.0)).alias("dlt")
    )


def by_calendar(dlts: DataFrame) -> DataFrame:
    """Warned failures by hour and by week day: count, mean, median (lead times unclamped)."""
    warned = dlts.filter("alert_us is not null")
    when = F.timestamp_micros("us")
    sides = warned.select(
        "dlt",
        F.explode(
            F.array(
                F.struct(F.lit("hour").alias("unit"), F.hour(when).alias("slot")),
                F.struct(F.lit("weekday").alias("unit"), F.weekday(when).alias("slot")),
            )
        ).alias("g"),
    ).select("g.*", "dlt")
    medians = quantiles(sides, F.col("dlt"), [0.5], keys=["unit", "slot"])
    stats = sides.groupBy("unit", "slot").agg(
        F.count("*").alias("failures"), F.avg("dlt").alias("mean_dlt")
    )
    return stats.join(medians, ["unit", "slot"]).select(
        "unit", "slot", "failures", "mean_dlt", F.col("value").alias("median_dlt")
    )


# ---------------------------------------------------------------- sweeps over thresholds


def _rises(ranks: np.ndarray) -> np.ndarray:
    """For each entry the next one of a higher rank (their number if there is none)."""
    after, waiting = np.full(len(ranks), len(ranks)), []
    known = ranks.tolist()
    for i, rank in enumerate(known):
        while waiting and known[waiting[-1]] < rank:
            after[waiting.pop()] = i
        waiting.append(i)
    return after


def _steps(score: np.ndarray, us: np.ndarray, failures: np.ndarray, first: np.ndarray, grid: np.ndarray) -> pd.DataFrame:
    """Steps of failures whose windows are the rows from ``first`` up to the failure."""
    alerts = np.flatnonzero(score > grid[0])
    ranks = np.searchsorted(grid, score[alerts], side="left")  # how many thresholds a row passes
    after = _rises(ranks)
    at, end = np.searchsorted(alerts, first), np.searchsorted(alerts, failures)
    passed, found = np.zeros(len(failures), dtype=np.int64), []
    while (live := np.flatnonzero(at < end)).size:
        here = at[live]
        lead = np.nan_to_num(np.maximum(0, us[failures[live]] - us[alerts[here]]))
        found.append((live, passed[live], ranks[here], lead))
        passed[live], at[live] = ranks[here], after[here]
    live = np.flatnonzero(passed < len(grid))
    found.append((live, passed[live], np.full(len(live), len(grid)), np.zeros(len(live))))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
    return pd.DataFrame(dict(zip(("_at", "low", "high", "lead_us"), columns)))


def lead_steps(
    df: DataFrame,
    thresholds: Sequence[float],
    *,
    keys: Sequence[str] = (),
    rows: int = 1000,
    order: Order | None = None,
    block_rows: int = 8192,
) -> DataFrame:
    """Lead time (``rows`` reading) of each failure at all thresholds, as steps.

    A row ``keys, line_id, low, high, lead_us`` says that the lead time is ``lead_us`` at the
    thresholds of ranks ``low`` to ``high - 1`` in rising order; the steps of a failure cover all
    thresholds, the last one often with 0 where no alert is left.  The earliest row above a threshold
    is one of those at which the highest score since the window's begin rises, so a failure
    follows pointers from each alert to the next higher one; how many there are depends on these rises,
    not on the thresholds.  A task sees a block of the order and the ``rows`` rows before it.
    """
    keys = tuple(keys)
    order = order or Order(keys)
    grid = np.sort(np.asarray(thresholds, dtype=np.float64))
    named = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("_score")
    failed = F.coalesce(F.col("label") == 1, F.lit(False)).alias("_failed")
    columns = list(dict.fromkeys([*keys, *order.columns, "line_id", "us"]))
    laid = blocks(df.select(*columns, score, failed), order, rows, block_rows)
    names = [*keys, "line_id", "low", "high", "lead_us"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord", kind="stable").reset_index(drop=True)
        failures = np.flatnonzero((pdf["_own"] & pdf["_failed"]).to_numpy())
        first = failures - np.minimum(pdf["_pos"].to_numpy()[failures], rows)
        values = pdf["_score"].to_numpy(dtype=np.float64)
        # SQL's order puts NaN above all numbers
        found = _steps(np.where(np.isnan(values), np.inf, values), pdf["us"].to_numpy(), failures, first, grid)
        whose = pdf[[*keys, "line_id"]].iloc[failures[found["_at"]]].reset_index(drop=True)
        return pd.concat([whose, found], axis=1)[names]

    schema = ", ".join([*(f"`{k}` {named[k]}" for k in keys), f"line_id {named['line_id']}", "low int, high int, lead_us long"])
    return laid.groupBy("_block").applyInPandas(run, schema)


def sensitivity(
    df: DataFrame,
    thresholds: Sequence[float],
    *,
    min_lead: float = 300.0,
    medians: bool = True,
    keys: Sequence[str] = (),
    order: Order | None = None,
) -> DataFrame:
    """Per threshold: F1, precision, recall, FPR, warning rate, mean/median/max lead time.

    With ``keys`` an alert warns only of failures of its own session.
    """
    quality = sweep(df, thresholds)
    ranked = [int(q) for q in np.argsort(np.asarray(thresholds, dtype=np.float64), kind="stable")]
    rank = F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("rank")
    steps = lead_steps(df, thresholds, keys=keys, order=order).select(rank, "lead_us")
    q = F.get(F.lit(ranked), F.col("rank")).cast("int").alias("q")
    # Counted per threshold (and lead time) before anything is shuffled.
    counts = steps.groupBy("rank", *(["lead_us"] if medians else [])).agg(
        F.count("*").alias("n"), F.sum("lead_us").alias("total"), F.max("lead_us").alias("most"),
        F.count_if(F.col("lead_us") >= min_lead * SECOND).alias("warned"),
    ).withColumn("q", q)
    if medians:
        counts = checkpointed(counts)
    failures = F.sum("n")
    stats = counts.groupBy("q").agg(
        (F.sum("warned") / failures * 100).alias("ewr"), (F.sum("total") / failures / float(SECOND)).alias("mean_dlt"),
        (F.max("most") / float(SECOND)).alias("max_dlt"),
    )
    none = {c: F.coalesce(c, F.lit(0.0)) for c in ("ewr", "mean_dlt", "max_dlt")}
    out = quality.join(F.broadcast(stats), "q", "left").withColumns(none)
    if medians:
        long = counts.select("q", (F.col("lead_us") / float(SECOND)).alias("dlt"), "n")
        out = out.join(F.broadcast(weighted_median(long, "q", "dlt", "n")), "q", "left")
    return out


def weighted_median(counts: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Median per key from ``value`` repeated ``weight`` times."""
    steps = running(counts, Order((key,), (value,)), {"_cum": ("sum", F.col(weight))})
    totals = counts.groupBy(key).agg(F.sum(weight).alias("_n"))
    placed = steps.join(F.broadcast(totals), key)
    low = F.floor((F.col("_n") - 1) / 2)
    high = F.ceil((F.col("_n") - 1) / 2)
    start = F.col("_cum") - F.col(weight)

    def covers(rank: Column) -> Column:
        return (start <= rank) & (rank < F.col("_cum"))

    return placed.filter(covers(low) | covers(high)).groupBy(key).agg(
        ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2)
        .alias("median_dlt")
    )


def best_early_threshold(
    table: DataFrame, target_fpr: float = 0.01
) -> DataFrame:
    """Highest warning rate under the FPR target (strictly above 0), else ``failed``.

    The best feasible threshold by F1 is reported as well.
    """
    row = F.struct(*table.columns)
    feasible = F.col("fpr") <= target_fpr
    picked = table.agg(
        F.max_by(row, F.when(feasible & (F.col("ewr") > 0), F.struct(F.col("ewr"), -F.col("q")))).alias("best"),
        F.max_by(row, F.col("q")).alias("last"),
        F.max_by(F.col("threshold"), F.when(feasible, F.struct(F.col("f1"), -F.col("q")))).alias("f1_threshold"),
        F.count_if(feasible).alias("feasible"),
    )
    return picked.select(
        F.when(F.col("best").isNull(), "failed").otherwise("success").alias("status"),
        F.coalesce("best.threshold", "last.threshold").alias("best_threshold"),
        *[F.col("best")[c].alias(c) for c in ("ewr", "fpr", "f1", "precision", "recall", "mean_dlt")],
        "f1_threshold", "feasible",
    )


def best_weighted_threshold(
    table: DataFrame, f1: float = 0.3, ewr: float = 0.5, fpr_penalty: float = 0.2
) -> DataFrame:
    """Threshold with the highest ``w1*F1 + w2*EWR - w3*FPR`` (weights scaled to sum 1)."""
    total = f1 + ewr + fpr_penalty
    objective = (
        F.lit(f1 / total) * F.col("f1")
        + F.lit(ewr / total) * (F.col("ewr") / 100)
        - F.lit(fpr_penalty / total) * F.col("fpr")
    )
    scored = table.withColumn("objective", objective)
    row = F.struct(*scored.columns)
    return scored.agg(F.max_by(row, F.struct(F.col("objective"), -F.col("q"))).alias("r")).select("r.*")


def pareto_front(table: DataFrame, maximise: Sequence[str], minimise: Sequence[str] = ()) -> DataFrame:
    """Thresholds no other threshold beats on every objective (the table is one row per threshold)."""
    goals = [(c, 1) for c in maximise] + [(c, -1) for c in minimise]
    mine = [F.col(f"a.{c}") * s for c, s in goals]
    other = [F.col(f"b.{c}") * s for c, s in goals]
    as_good = reduce(lambda x, y: x & y, [o >= m for o, m in zip(other, mine)])
    better = reduce(lambda x, y: x | y, [o > m for o, m in zip(other, mine)])
    return table.alias("a").join(F.broadcast(table).alias("b"), as_good & better, "left_anti")


def value_of(
    dlts: DataFrame,
    false_positives: Column,
    *,
    failure_cost: float = 10000.0,
    alarm_cost: float = 100.0,
    success_rate: float = 0.5,
    min_lead: float = 300.0,
) -> DataFrame:
    """Return on investment of early warnings, one row.

    ``roi_percentage`` keeps the published definition ``(ratio - 1) * 100``, although the
    ratio is already net benefit over cost.
    """
    base = dlts.agg(
        F.count("*").alias("total_failures"),
        F.count_if(F.col("dlt") >= min_lead).alias("actionable"),
    ).withColumn("fp", false_positives)
    prevented = F.floor(F.col("actionable") * F.lit(success_rate)).cast("long")
    infinite = F.lit(float("inf"))
    out = base.withColumn("prevented", prevented).withColumns({
        "savings": F.col("prevented") * F.lit(failure_cost),
        "alarm_cost": F.col("fp") * F.lit(alarm_cost),
    })
    out = out.withColumn("net_benefit", F.col("savings") - F.col("alarm_cost"))
    out = out.withColumn(
        "roi_ratio",
        F.when(F.col("alarm_cost") > 0, F.col("net_benefit") / F.col("alarm_cost"))
        .when(F.col("savings") > 0, infinite)
        .otherwise(F.lit(0.0)),
    )
    breakeven = F.floor(F.col("savings") / F.lit(alarm_cost)).cast("long") if alarm_cost > 0 else F.lit(0).cast("long")
    return out.withColumns({
        "roi_percentage": F.when(F.col("roi_ratio") == infinite, infinite).otherwise((F.col("roi_ratio") - 1) * 100),
        "breakeven_fp": breakeven,
    })


def operational_impact(dlts: DataFrame, response_seconds: float = 1200.0) -> DataFrame:
    """How often the lead time exceeds the response time (a parameter), one row."""
    d, r = F.col("dlt"), F.lit(float(response_seconds))
    positive = F.when(d > 0, d)
    row = dlts.agg(
        F.avg(d).alias("avg_dlt"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("avg_buffer"),
        (ratio(F.count_if(d > r), F.count(positive)) * 100).alias("adequate_pct"),
    )
    return row.select(
        r.alias("response_seconds"),
        F.coalesce("avg_dlt", F.lit(0.0)).alias("avg_dlt"), "avg_buffer", "adequate_pct",
        F.when(F.col("avg_buffer") > r, F.col("avg_buffer") - r).otherwise(0.0).alias("time_saved"),
    )
