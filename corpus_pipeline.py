"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omenlog.llm import bpe, mixing, quality, simhash, toxicity
from omenlog.llm.common import table
from omenlog.llm.queries import TOKENIZER
from omenlog.session import checkpointed, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts have the score of a text without evidence and stay; columns are those of
    ``docs`` whatever their names; an empty table gives an empty one.
    """
    ship(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views of the quality classifier together reject go.

    Null and empty texts are judged by their metadata; columns are those of ``docs``; an empty table
    gives an empty one.
    """
    ship(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Null and empty texts are near-duplicates of each other; columns are those of ``docs``; an empty
    table gives an empty one.
    """
    ship(spark)
    return simhash.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and the rows in them follow the position.

    A null source is a source; texts are not read.  The columns of ``docs`` travel in one structure,
    so names that the mix uses itself (``mix_position``) and names with dots stay what they are; an
    empty table gives an empty one.
    """
    ship(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    mixed = mixing.mix(docs.select(whole, F.col("source")))
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's source, place in the mix, tokens and the digest of its decoding.

    The mixing stage wrote its files in order, so (mix_file, mix_row) sorts as the mix; documents
    that come from no file have no place.  Null text is the empty text, without tokens; columns of
    ``docs`` other than doc_id, source and text are not read; an empty table gives an empty one.
    """
    ship(spark)
    try:
        place = [F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row")]
        placed = docs.select("doc_id", "source", "text", *place)
    except AnalysisException:
        place = [F.lit(None).cast("string").alias("mix_file"), F.lit(None).cast("long").alias("mix_row")]
        placed = docs.select("doc_id", "source", "text", *place)
    return bpe.encode(placed, TOKENIZER).select(
        "doc_id", "source", "mix_file", "mix_row", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifiers cannot be expressed in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else checkpointed(docs)
    return docs
