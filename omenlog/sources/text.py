"""Raw log files and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omenlog.functions.normalise import word_label
from omenlog.operators.order import Order, ordinal


def without_invalid(value: Column) -> Column:
    """Text without invalid bytes; a replacement character that was written stays.

    The written ones are put out of the way (with an escape for the escape itself) while
    invalid bytes become replacement characters and go.
    """
    mark, bad = "\ufdd0", "\ufffd"
    hidden = F.replace(F.replace(value, F.lit(mark), F.lit(mark + "a")), F.lit(bad), F.lit(mark + "b"))
    valid = F.replace(F.make_valid_utf8(hidden), F.lit(bad), F.lit(""))
    return F.replace(F.replace(valid, F.lit(mark + "b"), F.lit(bad)), F.lit(mark + "a"), F.lit(mark))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of text files: ``file, line_no, raw``, invalid bytes dropped.

    Spark splits large files; the place of a line is the start of its split plus its place
    inside it, so the numbering is one ordered pass over ``(file, split, place)``.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # place inside the split: the reader emits the lines of a split in order
        F.monotonically_increasing_id().alias("_place"),
        without_invalid(F.col("value")).alias("raw"),
    )
    return ordinal(read, Order(("file",), ("_block", "_place")), "line_no").drop("_block", "_place")


def capped(lines: DataFrame, limit: int | None, text: str = "raw") -> DataFrame:
    """Non-blank trimmed lines in order, at most ``limit`` of them."""
    kept = lines.select("line_id", F.trim(text).alias("line")).filter("line <> ''")
    return kept if limit is None else kept.orderBy("line_id").limit(limit)


def read_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV with ``BlockId, Label`` columns as ``block, label``."""
    rows = spark.read.schema("BlockId string, Label string").option("header", True).csv(path)
    return rows.select(
        F.col("BlockId").alias("block"),
        F.when(F.lower(F.trim("Label")) == "anomaly", 1).otherwise(0).alias("label"),
    )


def read_line_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file with one word per line as ``file, line_no, label``; blank lines are skipped."""
    rows = read_lines(spark, path).withColumn("label", word_label(F.col("raw")))
    kept = rows.filter("label is not null").select("file", F.col("line_no").alias("_n"), "label")
    return ordinal(kept, Order(("file",), ("_n",)), "line_no").drop("_n")
