"""Time deltas, event rates, feature scaling and the temporal profile of a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.functions.time import calendar
from omenlog.operators.order import Order, count_before, laid_out, quantile_list, running
from omenlog.operators.sweep import scaled
from omenlog.schema import SECOND


def gap_seconds(
    df: DataFrame, *, order: Order | None = None, name: str = "delta_t"
) -> DataFrame:
    """Seconds since the previous row of the order; null on the first row of a key."""
    order = order or Order()
    out = running(df, order, {"_prev": ("last", F.col("us"))}, exclusive=True)
    return out.withColumn(name, (F.col("us") - F.col("_prev")) / F.lit(float(SECOND))).drop("_prev")


def delta_ms(df: DataFrame, *, keys: Sequence[str] = (), by: Sequence[str] = ("line_id",)) -> DataFrame:
    """Milliseconds since the last *known* time in arrival order.

    Time going backwards counts as 0, and so do rows without a time and the first row.
    """
    out = running(df, Order(tuple(keys), tuple(by)), {"_prev": ("last", F.col("us"))}, exclusive=True)
    ms = (F.col("us") - F.col("_prev")) / F.lit(1000.0)
    return out.withColumn("delta_ms", F.greatest(F.coalesce(ms, F.lit(0.0)), F.lit(0.0))).drop("_prev")


def event_rates(
    df: DataFrame, windows: Mapping[str, int], *, keys: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Events of the key in ``[t - seconds, t)`` for each window: ``keys, line_id, <names>``.

    A rate is the difference of two running counts, so its cost does not depend on how
    many events a window holds.
    """
    moments = [("now", 0), *windows.items()]
    probes = df.select(
        *keys, "line_id",
        F.explode(
            F.array(*[
                F.struct(F.lit(n).alias("moment"), (F.col("us") - s * SECOND).alias("at"))
                for n, s in moments
            ])
        ).alias("m"),
    ).select(*keys, "line_id", "m.moment", "m.at")
    counted = count_before(
        probes, df.select(*keys, F.col("us").alias("at")), keys=keys, ranges=ranges
    )

    def seen(moment: str) -> Column:
        return F.max(F.when(F.col("moment") == moment, F.col("n")))

    return counted.groupBy(*keys, "line_id").agg(
        *[(seen("now") - seen(n)).alias(n) for n in windows]
    )


def features(df: DataFrame, *, keys: Sequence[str] = (), order: Order | None = None) -> DataFrame:
    """Time features of every row: gap, calendar, rates over 5 minutes and 1 hour, age."""
    keys = tuple(keys)
    order = order or Order(keys)
    base = gap_seconds(laid_out(df, order), order=order)
    base = running(base, order, {"_first": ("min", F.col("us"))})
    base = base.withColumns({
        "delta_t": F.coalesce("delta_t", F.lit(0.0)),
        **calendar(F.col("ts")),
        "time_since_start": (F.col("us") - F.col("_first")) / F.lit(float(SECOND)),
    }).drop("_first", order.range)
    rates = event_rates(
        df, {"rate_5min": 300, "rate_1hour": 3600}, keys=keys, ranges=order.ranges
    )
    return base.join(rates, [*keys, "line_id"])


def normalise(df: DataFrame, columns: Sequence[str], method: str = "minmax") -> tuple[DataFrame, DataFrame]:
    """Scale columns (minmax, zscore or log); returns the rows and the statistics used."""
    if method == "log":
        stats = df.sparkSession.createDataFrame(
            [(c, "log", None, None) for c in columns],
            "feature string, method string, first double, second double",
        )
        return df.withColumns({c: F.log1p(c) for c in columns}), stats
    pair = {"minmax": (F.min, F.max), "zscore": (F.avg, F.stddev_pop)}
    if method not in pair:
        raise ValueError(f"unknown scaling method: {method}")
    one, two = pair[method]
    row = df.agg(*[F.struct(one(c).cast("double").alias("a"), two(c).cast("double").alias("b")).alias(c) for c in columns])
    values = row.select(F.struct(*columns)).scalar()

    def scale(c: str) -> Column:
        a, b = F.col("_stats")[c]["a"], F.col("_stats")[c]["b"]
        if method == "minmax":
            return scaled(F.col(c), a, b)
        return F.when(b < 1e-8, F.lit(0.0)).otherwise((F.col(c) - a) / b)

    stats = row.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.lit(method).alias("method"),
                     F.col(c)["a"].alias("first"), F.col(c)["b"].alias("second"))
            for c in columns
        ])).alias("s")
    ).select("s.*")
    return df.withColumn("_stats", values).withColumns({c: scale(c) for c in columns}).drop("_stats"), stats


def profile(df: DataFrame, *, order: Order | None = None) -> DataFrame:
    """Temporal profile of a stream, one row: span, gaps, peak and quiet hours, weekdays."""
    gaps = gap_seconds(df, order=order).select("delta_t").filter("delta_t is not null")
    points = quantile_list(gaps, F.col("delta_t"), [0.5, 0.95, 0.99]) or [None] * 3
    gap_row = gaps.agg(
        F.avg("delta_t").alias("gap_mean"), F.stddev_pop("delta_t").alias("gap_std"),
        F.min("delta_t").alias("gap_min"), F.max("delta_t").alias("gap_max"),
    ).withColumns({
        n: F.lit(v).cast("double") for n, v in zip(("gap_median", "gap_p95", "gap_p99"), points)
    })
    # 24 x 7 cells carry everything the calendar part needs.
    cells = df.groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"),
        F.min("us").alias("lo"), F.max("us").alias("hi"),
    )
    hours = cells.groupBy("hour").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    peaks = hours.agg(
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"),
        F.max("n").alias("peak_count"),
        F.min_by("hour", F.struct(F.col("n"), F.col("hour"))).alias("quiet_hour"),
        F.min("n").alias("quiet_count"),
        F.max_by("hour", F.when(F.col("bad") > 0, F.struct(F.col("bad"), -F.col("hour")))).alias("peak_anomaly_hour"),
    )
    span = (F.max("hi") - F.min("lo")) / F.lit(3600.0 * SECOND)
    weekend = F.col("day") >= 5
    whole = cells.agg(
        F.sum("n").alias("total_events"),
        span.alias("span_hours"),
        F.when(span > 0, F.sum("n") / span).alias("events_per_hour"),
        F.coalesce(F.sum(F.when(weekend, F.col("n"))), F.lit(0)).alias("weekend_events"),
        (F.coalesce(F.sum(F.when(weekend, F.col("n"))), F.lit(0)) / F.sum("n") * 100).alias("weekend_pct"),
        *[F.coalesce(F.sum(F.when(F.col("day") == i, F.col("n"))), F.lit(0)).alias(d)
          for i, d in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))],
        F.sum("bad").alias("anomalies"),
        (F.sum("bad") / F.sum("n") * 100).alias("anomaly_rate"),
        F.when(F.sum("bad") > 0, F.coalesce(F.sum(F.when(weekend, F.col("bad"))), F.lit(0)) / F.sum("bad") * 100)
        .alias("anomaly_weekend_pct"),
    )
    return side_by_side(whole, peaks, gap_row)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames put next to each other (scalar subqueries, no join)."""
    first, *others = rows
    out = first
    for i, other in enumerate(others):
        out = out.withColumn(f"_s{i}", other.select(F.struct(*other.columns)).scalar())
        out = out.withColumns({c: F.col(f"_s{i}")[c] for c in other.columns}).drop(f"_s{i}")
    return out


def roll_up(df: DataFrame, value: str = "score") -> DataFrame:
    """Minute means averaged to hour means, by event time."""
    minutes = df.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.avg(value).alias("m"))
    return minutes.groupBy(F.window("w.start", "1 hour").alias("h")).agg(
        F.avg("m").alias("hour_mean"), F.count("*").alias("minutes")
    ).select(F.unix_micros("h.start").alias("hour_start"), "hour_mean", "minutes")


def roll_up_rows(df: DataFrame, rows: int = 60, *, order: Order | None = None, value: str = "score") -> DataFrame:
    """Means of every ``rows`` consecutive rows; an incomplete last stretch is left out."""
    from omenlog.operators.order import ordinal

    numbered = ordinal(df, order or Order())
    return numbered.groupBy(F.floor(F.col("pos") / rows).alias("step")).agg(
        F.avg(value).alias("mean"), F.count("*").alias("n")
    ).filter(F.col("n") == rows).drop("n")
