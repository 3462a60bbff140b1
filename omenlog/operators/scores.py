"""Scores over the ordered stream: hybrids, changes, trends and early-warning measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.operators.medians import with_median
from omenlog.operators.order import Order, laid_out, lookback, ordinal, running
from omenlog.operators.sweep import blend, scaled
from omenlog.schema import SECOND


def online_hybrid(
    df: DataFrame, a: str, b: str, alpha: float = 0.5, *, order: Order | None = None
) -> DataFrame:
    """Blend of two scores, each scaled by its running range up to the current row.

    Rows whose distance ``b`` is missing or negative (memory not ready) pass ``a`` through
    and do not widen the ranges.
    """
    ready = F.col(b) >= 0
    ranges = {
        f"_{side}_{c}": (side, F.when(ready, F.col(c))) for c in (a, b) for side in ("min", "max")
    }
    out = running(df, order or Order(), ranges)
    parts = [scaled(F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}")) for c in (a, b)]
    hybrid = F.when(ready, blend(*parts, alpha)).otherwise(F.col(a))
    return out.withColumn("hybrid", hybrid).drop(*ranges)


def batch_hybrid(df: DataFrame, a: str, b: str, alpha: float = 0.5) -> DataFrame:
    """Blend of two scores scaled by their global ranges."""
    span = df.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.withColumn("_r", span.select(F.struct(*span.columns)).scalar())
    parts = [scaled(F.col(c), F.col("_r")[f"lo_{c}"], F.col("_r")[f"hi_{c}"]) for c in (a, b)]
    return out.withColumn("hybrid", blend(*parts, alpha)).drop("_r")


def change_score(
    df: DataFrame, window: int = 50, method: str = "median", *, order: Order | None = None
) -> DataFrame:
    """Rise above the median (or mean) of the last ``window`` rows; raw until they exist."""
    if method not in ("median", "mean"):
        raise ValueError(f"unknown baseline: {method}")
    x, order = F.col("score"), order or Order()
    if method == "median":
        out, finish = with_median(df, window, order=order), lambda done: done
    else:
        frame, w, finish = lookback(df, order, window - 1)
        over = w.rowsBetween(-(window - 1), 0)
        out = frame.withColumns({"_n": F.count("*").over(over), "_base": F.avg(x).over(over)})
    delta = F.when(F.col("_n") < window, x).otherwise(F.greatest(F.lit(0.0), x - F.col("_base")))
    return finish(out.withColumn("delta_score", delta)).drop("_n", "_base")


def trend_score(
    df: DataFrame, window: int = 20, weight: float = 0.5, *, order: Order | None = None
) -> DataFrame:
    """Score plus ``weight`` times a rising linear trend over the last ``window`` rows."""
    order = order or Order()
    frame, w, finish = lookback(ordinal(laid_out(df, order), order, "_pos"), order, window - 1)
    over = w.rowsBetween(-(window - 1), 0)
    out = frame.withColumns({
        "_n": F.count("*").over(over), "_slope": F.regr_slope(F.col("score"), F.col("_pos")).over(over)
    })
    rise = F.greatest(F.lit(0.0), F.col("_slope")) * F.lit(float(weight))
    trend = F.when(F.col("_n") < window, F.col("score")).otherwise(F.col("score") + rise)
    return finish(out.withColumn("trend_score", trend)).drop("_n", "_slope", "_pos", order.range)


def warning_penalty(df: DataFrame, rows: int = 100, *, order: Order | None = None) -> DataFrame:
    """Mean over failures of ``1 / (1 + highest score of the previous rows)``."""
    frame, w, finish = lookback(df, order or Order(), rows)
    out = finish(frame.withColumn("_top", F.max("score").over(w.rowsBetween(-rows, -1))))
    failed = out.filter("label = 1 and _top is not null")
    return failed.agg(
        F.count("*").alias("failures"),
        F.coalesce(F.avg(1 / (1 + F.col("_top"))), F.lit(0.0)).alias("penalty"),
    )


def smoothness(df: DataFrame, *, order: Order | None = None) -> DataFrame:
    """Mean squared difference of consecutive scores."""
    out = running(df, order or Order(), {"_prev": ("last", F.col("score"))}, exclusive=True)
    step = F.col("score") - F.col("_prev")
    return out.agg(F.coalesce(F.avg(step * step), F.lit(0.0)).alias("smoothness"))


def ranking_violation(
    df: DataFrame, rows: int = 50, margin: float = 0.1, *, order: Order | None = None
) -> DataFrame:
    """Mean hinge ``max(0, margin - rise)`` over the steps of the rows before each failure."""
    order = order or Order()
    steps = running(laid_out(df, order), order, {"_prev": ("last", F.col("score"))}, exclusive=True).withColumn(
        "_hinge", F.greatest(F.lit(0.0), F.lit(margin) - (F.col("score") - F.col("_prev")))
    ).withColumn("_hinge", F.when(F.col("_prev").isNotNull(), F.col("_hinge")))
    frame, w, finish = lookback(steps, order, rows)
    over = w.rowsBetween(-(rows - 1), 0)
    out = finish(frame.withColumns({"_s": F.sum("_hinge").over(over), "_n": F.count("_hinge").over(over)}))
    return out.filter("label = 1").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("steps"),
        F.when(F.sum("_n") > 0, F.sum("_s") / F.sum("_n")).otherwise(0.0).alias("violation"),
    )


def time_to_failure(
    df: DataFrame, horizon: int = 300, *, keys: Sequence[str] = (), order: Order | None = None
) -> DataFrame:
    """Seconds to the next failure (null if none follows) and the pre-failure flag."""
    order = order or Order(tuple(keys))
    out = running(
        df, order, {"_next": ("min", F.when(F.col("label") == 1, F.col("us")))},
        exclusive=True, reverse=True,
    )
    ttf = (F.col("_next") - F.col("us")) / F.lit(float(SECOND))
    return out.withColumn("ttf", ttf).withColumn(
        "pre_failure", F.coalesce((F.col("ttf") > 0) & (F.col("ttf") <= horizon), F.lit(False)).cast("int")
    ).drop("_next")
