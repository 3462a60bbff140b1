"""Driving a stream over the files that are there, into a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omenlog.operators.order import quantile_list
from omenlog.schema import SECOND
from omenlog.session import new_folder

#: Rows of one arriving file; a slice of more rows arrives in several.
FILE_ROWS = 500_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, like: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A stream over parquet files with the schema of an existing table."""
    reader = spark.readStream.schema(spark.read.parquet(like).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # Written as a pattern, the path may be a folder of files or one file.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def files_of(df: DataFrame, *, slices: int = 6) -> int:
    """Into how many files ``staged`` should write a slice of these rows."""
    return max(1, -(-df.count() // (slices * FILE_ROWS)))


def staged(df: DataFrame, *, slices: int = 6, reach: int = 0, files: int = 1) -> tuple[str, str]:
    """Scored lines as files that arrive one after another: their folder, and how late rows may be.

    The order of time is cut into ``slices`` files, or so many times ``files``, which a stream should
    read as one batch; a slice is then written by as many tasks.  A tenth of the second one (by line number)
    arrives in a file of its own after the third.  Last comes a copy of the last row without a line
    number, whose time lies behind all others by the lateness and ``reach`` seconds, so that the
    watermark passes every row and every window of that length is closed.  (Its other columns are
    not null, as joins drop null keys before they see the time.)
    """
    spark = df.sparkSession
    folder = new_folder(spark, "arriving")
    cuts = quantile_list(df, F.col("us"), [i / slices for i in range(slices + 1)])
    if not cuts:
        df.coalesce(1).write.parquet(folder)
        return folder, "1 second"
    late = (F.pmod(F.xxhash64("line_id"), F.lit(10)) == 0)
    part = F.lit(0)
    for cut in cuts[1:-1]:
        part = part + (F.col("us") >= F.lit(cut)).cast("int")
    arrival = F.when((part == 1) & late, 2.5).otherwise(part.cast("double"))
    # Dealt out in one pass over the rows: a slice in one file would else be a pass in one task.
    dealt = new_folder(spark, "slices")
    df.withColumn("arrival", arrival).write.partitionBy("arrival").parquet(dealt)
    dealt = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("arrival", T.DoubleType())])).parquet(dealt)
    for k in sorted({*range(slices), 2.5}):
        rows = dealt.filter(F.col("arrival") == F.lit(float(k))).drop("arrival")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(folder)
    span = int(max(b - a for a, b in zip(cuts, cuts[2:] if slices > 1 else cuts[1:])) // SECOND) + 1
    last = F.max("us") + F.lit((span + reach + 86_400) * SECOND)
    own = {"us": last, "ts": F.timestamp_micros(last), "line_id": F.lit(None)}
    closing = [own.get(f.name, F.max_by(f.name, "us")).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    df.agg(*closing).coalesce(1).write.mode("append").parquet(folder)
    return folder, f"{span} seconds"


def run_available(
    stream: DataFrame, name: str, *, mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None, one_batch: bool = False,
) -> DataFrame:
    """Process everything available into a table below the shared folder and read it back.

    With ``each`` the function is applied to every micro-batch as a plain DataFrame.  The
    batch number names its folder, so a repeated batch replaces itself.  State that ages by
    the clock asks for further (empty) batches without end; ``one_batch`` stops after one.
    """
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)  # read when the query starts, then put back
    try:
        return _run(stream, name, mode, each, one_batch)
    finally:
        spark.conf.set(provider, before)


def _run(
    stream: DataFrame, name: str, mode: str, each: Callable[[DataFrame], DataFrame] | None, one_batch: bool,
) -> DataFrame:
    spark = stream.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    when = {"once": True} if one_batch else {"availableNow": True}
    writer = stream.writeStream.option("checkpointLocation", state).trigger(**when)
    if each is None:
        query = writer.outputMode(mode).format("parquet").start(out)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    shape = {}

    def write(batch: DataFrame, number: int) -> None:
        result = each(batch)
        shape["schema"] = result.schema
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.foreachBatch(write).start().awaitTermination()
    if not shape:  # no batch arrived
        return each(spark.createDataFrame([], stream.schema)).limit(0)
    return spark.read.schema(shape["schema"]).parquet(f"{out}/batch=*")
