"""The registered queries opN_<name>: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omenlog.llm import ann, bpe, chat, mixing, packing, periodic, quality, repair, sharding, simhash, topk, toxicity, urls
from omenlog.llm.common import table
from omenlog.session import ship


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("mix_source")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(chat.as_tool_calls(table(spark, sf_dir, "conversations")))
    return linked.withColumn("linked_turn", F.coalesce("linked_turn", F.lit(-1)))  # -1: not linked


#: The tokenizer file of op9 and of the pipeline.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.summary(conversations, repair.repair(repair.damaged(conversations)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_periods(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(docs))


def _run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _run(f) for f in (
        op1_toxicity, op2_simhash_near_dedup, op3_mix_sources, op4_exact_top_k, op5_shard_documents, op6_quality, op7_url_filters,
        op8_tool_calls, op9_bpe, op10_nearest, op11_packing, op12_repair,
        op13_periodic_runs,
    )
}

SQL: dict[str, str] = {
    "op4_exact_top_k": topk.top_k_sql(), "op7_url_filters": urls.judge_sql(), "op8_tool_calls": chat.link_sql(),
}
