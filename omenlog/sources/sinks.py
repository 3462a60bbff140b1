"""Writers for scores, splits, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scores(long: DataFrame, path: str) -> None:
    """Scores as a long table partitioned by score name; rows are found by line id."""
    long.write.mode("overwrite").partitionBy("score_name").parquet(path)


def write_split(rows: DataFrame, path: str) -> None:
    """Split rows partitioned by role, the label beside its line."""
    rows.write.mode("overwrite").partitionBy("role").parquet(path)


def write_events(df: DataFrame, path: str, *, by_day: bool = True) -> None:
    """Parsed events with their time as a column, partitioned by day for pruning."""
    if by_day:
        df = df.withColumn("day", F.to_date("ts"))
        df.write.mode("overwrite").partitionBy("day").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_statistics(row: DataFrame, path: str) -> None:
    """A one-row statistics frame as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Report texts (``model, file, text``), one file per model and report."""
    rows = reports.select(F.col("text").alias("value"), "model", F.lit("results").alias("kind"), "file")
    rows.write.mode("overwrite").partitionBy("model", "kind", "file").text(path)
