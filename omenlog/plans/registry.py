"""How a query is registered: a Spark plan plus, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omenlog.session import ship


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _uniform(df: DataFrame, digits: Mapping[str, int], nulls: Mapping[str, int]) -> DataFrame:
    """Whole numbers as BIGINT, named doubles rounded, nulls filled, as on the SQL side."""
    casts = {
        f.name: F.col(f.name).cast("long")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
    }
    rounds = {c: F.round(F.col(c).cast("double"), n) + F.lit(0.0) for c, n in digits.items()}
    fills = {c: F.coalesce(F.col(c), F.lit(v)).cast("long") for c, v in nulls.items()}
    return df.withColumns({**casts, **rounds, **fills})


def query(
    name: str,
    sql: str | None = None,
    *,
    digits: Mapping[str, int] | None = None,
    ints: Sequence[str] = (),
    nulls: Mapping[str, int] | None = None,
):
    """Register ``fn(spark, folder) -> DataFrame``.

    ``digits`` names doubles to round and ``nulls`` whole numbers whose nulls are shown as
    a given value, both in the result only.
    """
    digits, nulls = dict(digits or {}), dict(nulls or {})
    if sql is not None and (digits or ints or nulls):
        swaps = [f"round(CAST({c} AS DOUBLE), {n}) + 0.0 AS {c}" for c, n in digits.items()]
        swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
        swaps += [f"CAST(coalesce({c}, {v}) AS BIGINT) AS {c}" for c, v in nulls.items()]
        sql = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql}) AS answer"

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Timestamps without zone are read as UTC; the checks assume the same.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return _uniform(fn(spark, folder), digits, nulls)

        REGISTRY[name] = Query(run, sql)
        return fn

    return keep
