"""Helpers that several operators share: reading, whole-table numbering, bounded samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omenlog.session import checkpointed

#: A table of at most so many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def local(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A DataFrame of driver-made plan rows, given by column."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return spark.createDataFrame(pd.DataFrame({n: columns[n] for n in names}, columns=names), schema)


def share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``key`` (null is a value), in table order.

    Every task counts up per key while the table is written to the shared folder; the sizes of
    (key, task) give each task its offset.  No task ever gathers the rows of a key.
    """
    fields = [*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_seen", T.LongType())]

    def count_up(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(key).dictionary_encode(null_encoding="encode")
            values, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            base = np.array([seen.get(v, 0) for v in values], dtype=np.int64)
            at = pd.Series(codes).groupby(codes).cumcount().to_numpy() + base[codes]
            for code, n in zip(*np.unique(codes, return_counts=True)):
                seen[values[code]] = seen.get(values[code], 0) + int(n)
            arrays = [*batch.columns, pa.array(np.full(len(at), part, np.int64)), pa.array(at.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    kept = checkpointed(df.mapInArrow(count_up, T.StructType(fields)))
    sizes = kept.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(sizes.select("_key", "_of", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off")))
    joined = kept.join(
        small(offsets, offsets.count()), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of"))
    )
    return joined.withColumn(name, F.col("_seen") + F.col("_off")).drop("_part", "_seen", "_key", "_of", "_off")


def labelled(
    docs: DataFrame, labels: DataFrame, column: str, rows: int, *, keep: Column | None = None, seed: int = 1
) -> DataFrame:
    """A bounded sample of labelled documents with both classes: docs columns, ``_y``, ``_rate``.

    At most about ``rows / 2`` ids of each class are drawn by a hash of the id; ``_rate`` is the
    share drawn of the class, so that 1 / rate restores the true proportions.  Rows of ``labels``
    with null id or label are left out; an id with both labels counts as 1.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("_y"))
    if keep is not None:
        ids = labels.filter(keep).select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("_y"))
    ids = ids.filter("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, rows / 2 / max(1, sizes.get(y, 0))) for y in (0, 1)}
    rate = F.when(F.col("_y") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    drawn = ids.withColumn("_rate", rate).filter(share(F.col("_id"), seed) < F.col("_rate"))
    return docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["_id"]).drop("_id")
