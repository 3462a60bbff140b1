"""The given tables in the roles the operators expect, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omenlog.operators.order import quantile_list
from omenlog.schema import scored, split_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored lines: errors are the failures, ``k`` is a second score."""
    return scored(
        table(spark, folder, "events"),
        line_id="event_id", ts="ts", score="value",
        label=F.when(F.col("event_type") == "error", 1).otherwise(0),
        key="user_id", kind="event_type",
        dist=F.regexp_extract("props", r"(\d+)", 1).cast("double"),
    )


EV = """ev AS (
  SELECT event_id AS line_id, ts, epoch_us(ts) AS us, value AS score,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         user_id AS key, event_type AS kind,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS dist
  FROM events)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as raw log lines: ``line_id, owner, line_no, source, raw``."""
    return split_lines(table(spark, folder, "documents"), "doc_id", "text", "source")


LN = """ln AS (
  SELECT owner * 2147483648 + line_no AS line_id, owner, line_no, source, raw
  FROM (SELECT doc_id AS owner, source,
               unnest(string_split(text, chr(10))) AS raw,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents))"""


def normal_p99(df: DataFrame) -> float:
    """Alert threshold: the 99th percentile of the normal scores."""
    return quantile_list(df.filter("label = 0"), F.col("score"), [0.99])[0]


THR = "thr AS (SELECT quantile_cont(score, 0.99) AS t FROM ev WHERE label = 0)"


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a disordered stream with many equal times."""
    return scored(
        table(spark, folder, "orders"),
        line_id="o_orderkey", ts="o_orderdate", score="o_totalprice",
        label=F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), key="o_custkey",
    )


ORD = """ord AS (
  SELECT o_orderkey AS line_id, o_orderdate AS ts, epoch_us(o_orderdate) AS us,
         o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         o_custkey AS key
  FROM orders)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as line vectors: label 0 is one class, the others the rest."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("line_id"), F.col("vec_id").alias("us"),
        F.col("embedding").alias("vec"), "label",
    )
