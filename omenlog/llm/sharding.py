"""Sharding by longest-processing-time scheduling: equal texts stay together, shards get equal bytes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.llm.common import local, numbered
from omenlog.session import checkpointed

#: A group above total / GRAIN bytes is scheduled by itself (there are fewer than GRAIN of them);
#: smaller groups are scheduled in at most GRAIN bundles.
GRAIN = 1 << 16


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: items by falling size, each to the least-loaded shard (heap)."""
    heap = [(0, s) for s in range(shards)]
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heap[0]
        placed[i] = shard
        heapq.heapreplace(heap, (load + sizes[i], shard))
    return placed


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    A group is all rows of equal text.  Its bytes are summed map-side first, so a hot group costs
    one row per task.  Groups above 1/65536 of all bytes go one by one through the heap; the rest
    is dealt by hash into 65536 bundles that go through it the same way.  Both lists are bounded
    by ``GRAIN`` whatever the input, and no bundle holds a group that could unbalance a shard.

    Null text is the empty text (size 1, checksum 0); null and repeated ids are ordinary rows;
    equal sizes are taken in the order of the group's hash; an empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"),
    ))
    groups = checkpointed(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    single = F.col("bytes") > F.lit(total / GRAIN)
    bundle = F.pmod(F.col("grp"), F.lit(GRAIN))
    large = groups.filter(single).orderBy("grp").toPandas()
    bundles = groups.filter(~single).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    bundles = bundles.orderBy("bundle").toPandas()

    placed = longest_first([*large["bytes"].tolist(), *bundles["bytes"].tolist()], shards)
    singly = local(spark, {"grp": large["grp"].tolist(), "s1": placed[: len(large)]}, "grp long, s1 int")
    bundled = local(spark, {"bundle": bundles["bundle"].tolist(), "s2": placed[len(large):]}, "bundle long, s2 int")
    # Both plans have at most GRAIN rows of two numbers.
    sharded = (
        rows.join(F.broadcast(singly), "grp", "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(bundled), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                F.coalesce("s1", "s2").cast("int").alias("shard"))
    )
    return numbered(sharded, "shard", "slot").withColumn("grown_shard", F.lit(None).cast("int")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
