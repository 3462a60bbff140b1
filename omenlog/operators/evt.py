"""Extreme-value thresholds: peaks over a high quantile, generalised Pareto tail."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.order import quantiles
from omenlog.session import checkpointed

LEAST = 5
POINTS = 32
ROUNDS = 6


def tail(df: DataFrame, quantile: float = 0.98, *, keys: Sequence[str] = ()) -> DataFrame:
    """Exceedances over the quantile, counted per distinct value: ``keys, u, y, c``."""
    u = quantiles(df, F.col("score"), [quantile], keys=keys).select(*keys, F.col("value").alias("u"))
    if keys:
        high = df.join(checkpointed(u), list(keys)).filter(F.col("score") > F.col("u"))
    else:
        high = df.withColumn("u", u.select("u").scalar()).filter(F.col("score") > F.col("u"))
    return high.groupBy(*keys, "u", (F.col("score") - F.col("u")).alias("y")).agg(F.count("*").alias("c"))


def moments(df: DataFrame, quantile: float = 0.98, *, keys: Sequence[str] = ()) -> DataFrame:
    """Shape and scale by the method of moments: ``keys, u, k, xi, sigma``."""
    high = tail(df, quantile, keys=keys)
    k, s1, s2 = F.sum("c"), F.sum(F.col("c") * F.col("y")), F.sum(F.col("c") * F.col("y") * F.col("y"))
    row = high.groupBy(*keys).agg(F.max("u").alias("u"), k.alias("k"), (s1 / k).alias("m"), (s2 / k).alias("s2"))
    square = F.col("m") * F.col("m")
    v = F.col("s2") - square
    return row.select(
        *keys, "u", "k",
        F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (1 - square / v))).alias("xi"),
        F.greatest(0.5 * F.col("m") * (1 + square / v), F.lit(1e-6)).alias("sigma"),
    )


def fit(
    df: DataFrame,
    quantile: float = 0.98,
    risk: float = 0.001,
    *,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Threshold whose exceedance probability is ``risk``: ``keys, n, k, u, xi, sigma, threshold``.

    The tail is fitted by maximum likelihood.  For ``theta = xi / sigma`` the best shape is
    the mean of ``log(1 + theta * y)``, so the likelihood depends on theta alone; each round
    evaluates it on a grid of thetas in one aggregation over the tail and narrows the grid
    around the best.  With fewer than LEAST exceedances the plain quantile is used.
    """
    if not 0 < quantile < 1 or not 0 < risk < 1:
        raise ValueError("quantile and risk lie strictly between 0 and 1")
    high = checkpointed(tail(df, quantile, keys=keys))
    edge = high.groupBy(*keys).agg(
        F.max("u").alias("u"), F.sum("c").alias("k"), F.max("y").alias("y_max"),
        (F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("y_mean"),
    )
    # theta > -1 / y_max keeps 1 + theta * y positive; s in (0, 1) covers (-1/y_max, inf)
    state = edge.withColumns({"lo": F.lit(1e-6), "hi": F.lit(1.0 - 1e-6)})
    for _ in range(ROUNDS):
        state = checkpointed(_narrow(high, state, keys))
    shape, scale = F.col("best.xi"), F.col("best.sigma")
    counts = df.groupBy(*keys).agg(F.count("score").alias("n"))
    plain = quantiles(df, F.col("score"), [1.0 - risk], keys=keys).select(*keys, F.col("value").alias("plain"))
    if keys:
        base = counts.join(plain, list(keys)).join(state, list(keys), "left")
    else:
        one = state.select(F.struct(*state.columns)).scalar()  # null when nothing exceeds u
        base = counts.withColumn("plain", plain.select("plain").scalar()).withColumn("_s", one)
        base = base.select("n", "plain", *[F.col("_s")[c].alias(c) for c in state.columns])
    rarity = F.col("n") / F.col("k") * risk
    general = F.col("u") + scale / shape * (F.pow(rarity, -shape) - 1)
    exponential = F.col("u") - scale * F.log(rarity)
    few = F.coalesce(F.col("k") < LEAST, F.lit(True))
    return base.select(
        *keys, "n", F.coalesce("k", F.lit(0)).alias("k"), "u",
        F.when(few, 0.0).otherwise(shape).alias("xi"),
        F.when(few, 1.0).otherwise(scale).alias("sigma"),
        F.when(few, F.col("plain")).when(F.abs(shape) < 1e-6, exponential).otherwise(general).alias("threshold"),
    )


def _theta(s: Column) -> Column:
    """Map s in (0, 1) to theta in (-1/y_max, inf); s = 1/2 is theta = 0."""
    return (F.lit(2.0) * s - 1) / ((1 - s) * F.col("y_max"))


def _narrow(high: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One round: likelihood on a grid per key, then a bracket around the best point."""
    frame = state.drop("best")
    step = (F.col("hi") - F.col("lo")) / (POINTS - 1)
    places = F.sequence(F.lit(0), F.lit(POINTS - 1))
    thetas = frame.withColumn("thetas", F.transform(places, lambda i: _theta(F.col("lo") + step * i)))
    narrow = thetas.select(*keys, "thetas")
    joined = high.join(narrow, list(keys)) if keys else high.withColumn(
        "thetas", narrow.select("thetas").scalar()
    )
    logs = [F.sum(F.col("c") * F.log1p(F.get("thetas", F.lit(i)) * F.col("y"))) for i in range(POINTS)]
    sums = joined.groupBy(*keys).agg(F.array(*logs).alias("logs"))
    both = thetas.join(sums, list(keys)) if keys else thetas.withColumn("logs", sums.select("logs").scalar())

    def point(theta: Column, i: Column) -> Column:
        xi = F.get("logs", i) / F.col("k")
        near_zero = F.abs(theta * F.col("y_mean")) < 1e-9
        sigma = F.when(near_zero, F.col("y_mean")).otherwise(xi / theta)
        loss = F.log(sigma) + F.when(near_zero, 0.0).otherwise(xi) + 1
        return F.struct(
            F.when(loss.isNull() | F.isnan(loss), float("inf")).otherwise(loss).alias("loss"),
            F.when(near_zero, 0.0).otherwise(xi).alias("xi"), sigma.alias("sigma"),
            (F.col("lo") + step * F.greatest(i - 1, F.lit(0))).alias("lo"),
            (F.col("lo") + step * F.least(i + 1, F.lit(POINTS - 1))).alias("hi"),
        )

    found = both.withColumn("best", F.array_min(F.transform("thetas", point)))
    return found.select(
        *keys, "u", "k", "y_max", "y_mean", F.col("best.lo").alias("lo"), F.col("best.hi").alias("hi"), "best"
    )
