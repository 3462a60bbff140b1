"""Timestamps in raw lines, time deltas and calendar features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where each log dialect keeps its event time.
TIME_PATTERNS = {
    "bgl": r"^(?:-|\w+)?\s*(\d{10})\s",
    "thunderbird": r"^-\s+(\d{10})\s",
    "hdfs": r"^(\d{6})\s+(\d{6})",
}
# Thunderbird lines with any first tag: the strict pattern never times an anomaly.
ANY_TAG = r"^\S+\s+(\d{10})\s"


def event_time(raw: Column, dialect: str, *, any_tag: bool = False) -> Column:
    """Event time of a raw line as TIMESTAMP, null when absent or not a valid date."""
    if dialect not in TIME_PATTERNS:
        raise ValueError(f"unknown log dialect: {dialect}")
    pattern = "(?U)" + (ANY_TAG if any_tag and dialect == "thunderbird" else TIME_PATTERNS[dialect])
    first = F.regexp_extract(raw, pattern, 1)
    if dialect != "hdfs":
        return F.timestamp_seconds(F.when(first != "", first).cast("long"))
    second = F.regexp_extract(raw, pattern, 2)

    def part(text: Column, at: int) -> Column:
        return F.substring(text, at, 2).try_cast("int")

    return F.when(
        first != "",
        F.try_make_timestamp(
            part(first, 1) + 2000, part(first, 3), part(first, 5),
            part(second, 1), part(second, 3),
            # second 60 would roll over to the next minute instead of being rejected
            F.when(part(second, 5) < 60, part(second, 5)),
        ),
    )


def log_delta(milliseconds: Column) -> Column:
    """``log1p`` of a time delta, negatives read as 0."""
    return F.log1p(F.greatest(F.lit(0.0), milliseconds))


def calendar(ts: Column) -> dict[str, Column]:
    """Hour of day, day of week (Monday 0) and the weekend flag."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    """Sine and cosine of a periodic value."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def periodic(
    delta: Column, linear: tuple[float, float], waves: Sequence[tuple[float, float]]
) -> Column:
    """One linear and several sine components of a time delta, as an array.

    ``linear`` and ``waves`` are (frequency, phase) pairs given by the caller.
    """
    first = F.lit(float(linear[0])) * delta + F.lit(float(linear[1]))
    return F.array(first, *[F.sin(F.lit(float(w)) * delta + F.lit(float(p))) for w, p in waves])


def feature_vector(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted features as one array, in the given order."""
    weights = weights or {}
    return F.array(*[c.cast("double") * F.lit(float(weights.get(n, 1.0))) for n, c in features.items()])
