"""Word surprise from counts: how unexpected each word is between its neighbours.

A model is trained on normal lines by grouping alone.  The probability of a word comes
from the longest context seen in training - both neighbours, the left one, or none - with
additive smoothing, so the largest probability in a context is a grouped maximum too.
Scoring gives, per word, ``err = -ln p(word)`` and ``prob = 1 - max p``: the contract of
any other per-word scorer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from omenlog.functions.scoring import extreme_means, pool
from omenlog.functions.words import START, contexts, pieces, words
from omenlog.operators import positions as moves
from omenlog.operators.dedup import score_once
from omenlog.operators.order import quantile_list
from omenlog.session import checkpointed, compact, passing

SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")  # fixed values
TOP_KS = (1, 3, 5, 10)
#: Between words, as ``functions.words.words`` cuts them.
WHITE = r"[ \t\n\x0b\f\r]+"


def _tokens(text: Column, unit: str) -> Column:
    if unit not in ("word", "piece"):
        raise ValueError(f"unknown unit: {unit}")
    return words(text) if unit == "word" else F.flatten(F.transform(words(text), pieces))


def _cut(text: Column, unit: str) -> Column:
    """The words of a line for the Arrow batches of ``positions``, where whole texts are cut faster than here."""
    return text if unit == "word" else _tokens(text, unit)


def positions(df: DataFrame, text: str = "norm", *, unit: str = "word", keep: Sequence[str] = ()) -> DataFrame:
    """One row per word (or sub-word piece): ``pos, word, left, right`` plus ``keep``."""
    return df.select(*keep, _tokens(F.col(text), unit).alias("_t")).select(
        *keep, F.posexplode(contexts(F.col("_t"))).alias("pos", "c")
    ).select(*keep, "pos", "c.word", "c.left", "c.right")


#: Pairs of neighbours that hold so many positions of a sample of one line in ``SAMPLED`` are counted apart.
FREQUENT, SAMPLED = 1_000, 64
#: Most of these pairs; the others are too rare to fill a task.
MOST_FREQUENT = 4_096
#: Characters of the lines in one group of positions.
PART_LENGTH = 16_000_000
#: In so many runs the groups are dealt and counted; only one run's blocks are on the disks at a time.
TURNS = 2


@dataclass(frozen=True)
class CountModel:
    """The distinct lines of the training with their copies, and the words in them.

    Nearly every word between its neighbours is unique, so a table of counts in context would be
    as long as the lines: the contexts are counted where lines are scored, in the same shuffle.
    """

    lines: DataFrame  # line, copies
    word: DataFrame  # word, c
    smoothing: float = 0.1
    unit: str = "word"

    @property
    def totals(self) -> DataFrame:
        return self.word.agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.count("*").alias("v"))


def train(
    df: DataFrame, text: str = "norm", *, smoothing: float = 0.1, unit: str = "word",
    write: Callable[[DataFrame], DataFrame] = compact,
) -> CountModel:
    """Take in the words of normal lines with their contexts.

    Lines are counted before they are cut into words, so a template with many copies is
    cut once.  ``write`` writes the model's tables.
    """
    lines = write(df.groupBy(F.col(text).alias("line")).agg(F.count("*").alias("copies")))
    return CountModel(lines, write(_counted_words(lines, unit)), smoothing, unit)


def _counted_words(lines: DataFrame, unit: str) -> DataFrame:
    """The words of lines (``line, copies``) with their copies; they are counted in each batch of lines."""
    cut = lines.select("copies", _cut(F.col("line"), unit).alias("words"))
    return cut.mapInArrow(moves.count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def trained(
    df: DataFrame, normal: Column, text: str = "norm", *, smoothing: float = 0.1, unit: str = "word",
    write: Callable[[DataFrame], DataFrame] = compact,
) -> tuple[CountModel, DataFrame]:
    """The model of the normal lines, and all distinct lines with number and copies among these: one grouping for both.

    ``write`` writes the table of the lines.
    """
    lines = write(df.groupBy(text).agg(F.count_if(normal).alias("copies")).withColumn("line_no", F.monotonically_increasing_id()))
    own = lines.filter("copies > 0").select(F.col(text).alias("line"), "copies")
    return CountModel(own, compact(_counted_words(own, unit)), smoothing, unit), lines


def frequent(lines: DataFrame, *, unit: str = "word") -> moves.Frequent:
    """The pairs of neighbours that would fill a task, by a sample of the lines, and their exact counts.

    The sample only says how a pair is counted, not what is counted.
    """
    def cut(df: DataFrame) -> DataFrame:
        return df.select(F.col("copies").cast("long").alias("copies"), _cut(F.col("line"), unit).alias("words"))

    some = cut(lines.filter(F.pmod(F.xxhash64("line"), F.lit(SAMPLED)) == 0))
    counts = some.mapInArrow(moves.count_neighbours, "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "left", "right").limit(MOST_FREQUENT).collect()
    if not rows:
        return moves.Frequent()
    often = moves.Frequent([(r["left"], r["right"], 0, 0) for r in rows])
    with passing(lines.sparkSession) as step:
        triples = step(
            cut(lines).mapInArrow(moves.count_triples(often), "pair int, word string, c3 long, n long").groupBy("pair", "word")
            .agg(F.sum("c3").alias("c3"), F.sum("n").alias("n"))
        )
        totals = {r[0]: (r[1], r[2]) for r in triples.groupBy("pair").agg(F.sum("c3"), F.max("c3")).collect()}
        # so many positions each: there are few of them
        hot = triples.filter(F.col("n") >= FREQUENT * SAMPLED).select("pair", "word", "c3").collect()
    pairs = [(*p[:2], *totals[i]) for i, p in enumerate(often.pairs)]
    return moves.Frequent(pairs, [tuple(r) for r in hot])


def tasks_for(lines: DataFrame) -> int:
    """Among how many groups the positions of lines are dealt: about three million in each."""
    return 32 + (lines.agg(F.sum(F.length("line"))).first()[0] or 0) // PART_LENGTH


def counted(
    lines: DataFrame, *, unit: str = "word", parts: int | None = None, spread: Sequence[str] = (),
    often: moves.Frequent | None = None, turn: int = 0, turns: int = 1,
) -> DataFrame:
    """Positions of lines (``key, line, copies``) with the copies of their triple and pair.

    The positions move once, in blocks, to the task of their pair (see ``positions``).  What comes out
    are blocks for the task of their line, and rows (``key, pos, left, word``) of the pairs that no copy has.
    Of several ``turns`` each counts its own pairs.
    """
    parts, often = parts or tasks_for(lines), often or frequent(lines, unit=unit)
    cut = lines.select("key", F.col("copies").cast("long").alias("copies"), _cut(F.col("line"), unit).alias("words"))
    dealt = cut.mapInArrow(moves.cut(parts, often, turn, turns), moves.MOVED).groupBy("part")
    return dealt.applyInArrow(moves.count(parts, often, spread), moves.COUNTED)


@dataclass(frozen=True)
class Answers:
    """Answered positions, in blocks and rows by ``part``, the task of their line."""

    rows: DataFrame
    parts: int
    smoothing: float
    room: float  # one share for words never seen

    def signals(self) -> DataFrame:
        """``key, errors[], probs[]`` in word order."""
        return self.rows.groupBy("part").applyInArrow(moves.gather(self.smoothing, self.room), moves.SIGNALS)

    def beside(self, lines: DataFrame) -> DataFrame:
        """The columns of ``lines`` (with ``key``) with ``errors[], probs[]``: the texts move to their answers, which are longer."""
        dealt = lines.mapInArrow(moves.deal(self.parts), moves.MOVED).groupBy("part")
        schema = StructType([*lines.schema.fields, *(StructField(n, ArrayType(DoubleType())) for n in ("errors", "probs"))])
        return self.rows.groupBy("part").cogroup(dealt).applyInArrow(
            moves.gather_texts(self.smoothing, self.room, to_arrow_schema(lines.schema)), schema)


def answered(model: CountModel, lines: DataFrame, *, write: Callable[[DataFrame], DataFrame] = compact) -> Answers:
    """The answers to the positions of lines (``key, line``, distinct) that have words.

    Only words whose neighbours were never seen together are looked up by the left neighbour, and
    only those whose left neighbour is new by the word alone.  Lines that bring their ``copies`` in
    the training are not matched with it again.  ``write`` writes the tables that the answers read;
    besides these they read ``model.word``.
    """
    totals = model.totals.first()
    room = model.smoothing * (totals["v"] + 1)
    # the most frequent words have more right neighbours than a task should hold
    spread = [START, *(r["word"] for r in model.word.orderBy(F.col("c").desc(), "word").limit(MOST_FREQUENT).collect())]

    def answer(df: DataFrame, count: str, top: Column, total: Column) -> DataFrame:
        p = (F.coalesce(F.col(count), F.lit(0)) + model.smoothing) / (total + room)
        best = (top + model.smoothing) / (total + room)
        return df.select("part", F.lit(None).cast("binary").alias("block"), "key", "pos", (-F.log(p)).alias("err"), (1 - best).alias("prob"))

    with passing(lines.sparkSession) as step:
        if "copies" in lines.columns:
            texts = lines.select("key", "line", "copies")
        else:
            # A line of the training is one row with its copies, whether it is to be scored or not.
            own = lines.select("key", "line", F.lit(0).cast("long").alias("copies"))
            every = own.unionByName(model.lines.select(F.lit(None).cast("long").alias("key"), "line", "copies"))
            texts = step(every.groupBy("line").agg(F.max("key").alias("key"), F.sum("copies").alias("copies")))
        parts, often = tasks_for(texts), frequent(texts, unit=model.unit)
        found = reduce(DataFrame.unionByName, [
            write(counted(texts, unit=model.unit, parts=parts, spread=spread, often=often, turn=turn, turns=TURNS))
            for turn in range(TURNS)
        ])
    none = [F.lit(None).cast(kind).alias(n) for n, kind in (("key", "long"), ("pos", "int"), ("err", "double"), ("prob", "double"))]
    out = found.filter("block is not null").select("part", "block", *none)
    rest = found.filter("block is null").drop("block")
    if not rest.isEmpty():
        seen = model.lines.select(F.col("copies").cast("long").alias("copies"), _cut(F.col("line"), model.unit).alias("words"))
        pairs = seen.mapInArrow(moves.cut_pairs(parts, spread), moves.MOVED)
        both = write(
            rest.groupBy("from_left").cogroup(pairs.groupBy("part")).applyInArrow(moves.count_pairs, moves.FOLLOWED)
        )
        left = both.filter("key is null").groupBy("left").agg(F.sum("n2").alias("n2"), F.max("m2").alias("m2"))
        rest = both.filter("key is not null").drop("n2", "m2").join(left, "left", "left")
        alone = rest.filter("n2 is null").join(model.word.withColumnRenamed("c", "c1"), "word", "left")
        n, top = (F.lit(totals[c]).cast("long") for c in ("n", "top"))
        out = out.unionByName(answer(rest.filter("n2 is not null"), "c2", F.col("m2"), F.col("n2")))
        out = out.unionByName(answer(alone, "c1", top, n))
    return Answers(out, parts, model.smoothing, room)


def surprise(model: CountModel, lines: DataFrame, *, write: Callable[[DataFrame], DataFrame] = compact) -> DataFrame:
    """``key, errors[], probs[]`` in word order for lines (``key, line``, distinct) that have words."""
    return answered(model, lines, write=write).signals()


def numbered_lines(
    df: DataFrame, text: str = "norm", *, write: Callable[[DataFrame], DataFrame] = compact
) -> DataFrame:
    """The distinct lines with a number, written once: later steps carry the number, not the text."""
    return write(df.select(text).distinct().withColumn("line_no", F.monotonically_increasing_id()))


def word_scores(
    model: CountModel, lines: DataFrame, *, text: str = "norm", key: str = "line_no", keep: Sequence[str] = (),
) -> DataFrame:
    """Per-word surprises of distinct lines: ``key, pos, word, err, prob`` plus ``keep``."""
    if lines.schema[key].dataType.typeName() != "long":
        numbered = compact(lines.withColumn("_no", F.monotonically_increasing_id()))
        return word_scores(model, numbered, text=text, key="_no", keep=[key, *keep]).drop("_no")
    answers = answered(model, _keyed(lines, key, text))
    # under names of their own: ``keep`` may hold any
    own = [F.col(key).alias("key"), F.col(text).alias("_text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))]
    cells = F.arrays_zip(_tokens(F.col("_text"), model.unit).alias("word"), "errors", "probs")
    kept = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    rows = answers.beside(lines.select(*own)).select(F.col("key").alias(key), *kept, F.posexplode(cells).alias("pos", "c"))
    return rows.select(key, *keep, "pos", "c.word", F.col("c.errors").alias("err"), F.col("c.probs").alias("prob"))


def _keyed(lines: DataFrame, key: str, text: str) -> DataFrame:
    copies = [c for c in ("copies",) if c in lines.columns]
    return lines.select(F.col(key).alias("key"), F.col(text).alias("line"), *copies)


def line_signals(
    model: CountModel, lines: DataFrame, *, text: str = "norm", write: Callable[[DataFrame], DataFrame] = compact
) -> DataFrame:
    """``line_no, errors[], probs[]`` of numbered lines (``line_no``, ``text``, perhaps ``copies``)."""
    return surprise(model, _keyed(lines, "line_no", text), write=write).withColumnRenamed("key", "line_no")


def to_lines(df: DataFrame, lines: DataFrame, scores: DataFrame | None = None, *, text: str = "norm") -> DataFrame:
    """Scores of numbered lines (``line_no``) for all rows of ``df``, matched by a digest so that no text moves.

    Without scores, the numbers themselves.
    """
    digest = F.unhex(F.sha2(F.col(text), 256))
    named = lines.select("line_no", digest.alias("_line"))
    if scores is not None:
        named = named.join(scores, "line_no").drop("line_no")
    return df.withColumn("_line", digest).join(named, "_line").drop("_line")


def top_k_families(ks: Sequence[int] = TOP_KS) -> Column:
    """Three score families for every k, of one line's ``errors`` and ``probs``.

    The words of a line are sorted once for all k, in Arrow batches.
    """
    ks = [int(k) for k in ks]

    def run(errors: pa.Array, probs: pa.Array) -> pa.Array:
        error, (probtopk, prob) = extreme_means(errors, ks)[0], extreme_means(probs, ks)
        n = len(errors)
        # of one k after the other, and from there of one line after the other
        by_line = pa.array(np.arange(len(ks) * n).reshape(len(ks), n).T.ravel())
        columns = {"k": pa.array(np.repeat(np.array(ks, dtype=np.int32), n))}
        columns |= {c: pa.concat_arrays(v) for c, v in (("error", error), ("prob", prob), ("probtopk", probtopk))}
        cells = pa.StructArray.from_arrays([c.take(by_line) for c in columns.values()], list(columns))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(ks)), cells)

    kind = "array<struct<k:int,error:double,prob:double,probtopk:double>>"
    return F.arrow_udf(run, kind)(F.col("errors"), F.col("probs"))


def top_k_scores(arrays: DataFrame, ks: Sequence[int] = TOP_KS, keep: Sequence[str] = ("norm",)) -> DataFrame:
    """Three score families for every k, from one pass over the arrays."""
    return arrays.select(*keep, F.explode(top_k_families(ks)).alias("s")).select(*keep, "s.*")


def adaptive_scores(arrays: DataFrame, keep: Sequence[str] = ("norm",)) -> DataFrame:
    """Scores that do not depend on k: mean and 99th percentile of both signals."""
    return arrays.select(
        *keep,
        *[
            pool(F.col(column), mode, 99).alias(f"{name}_{suffix}")
            for name, column in (("error", "errors"), ("prob", "probs"))
            for suffix, mode in (("mean", "mean"), ("pctl99", "pctl"))
        ],
    )


def long_scores(line_scores: DataFrame, names: Sequence[str], key: str = "line_id") -> DataFrame:
    """Wide scores as ``key, score_name, score`` rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("score")) for n in names])
    return line_scores.select(key, F.explode(cells).alias("s")).select(key, "s.*")


def with_model(
    df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str,
    *, text: str = "norm",
) -> DataFrame:
    """A scorer of one's own, run in Arrow batches over the distinct lines only.

    ``fn`` gets frames with the text column and returns it with the columns of ``schema``.
    """
    return score_once(df, lambda once: once.mapInPandas(fn, schema), text=text)


# ------------------------------------------------------------------ vocabularies


def word_counts(df: DataFrame, text: str = "norm") -> DataFrame:
    """Words with their frequency (words are counted in each batch of lines, so no text moves)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(pc.split_pattern_regex(batch["line"], WHITE).flatten())
            word = found.field("values")
            yield pa.RecordBatch.from_arrays([word, found.field("counts")], ["word", "n"]).filter(pc.not_equal(word, ""))

    counts = df.select(F.col(text).alias("line")).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text: str = "norm", *, size: int = 30_000, min_frequency: int = 2) -> DataFrame:
    """Word ids: special tokens first, then words by frequency (ties by word)."""
    room = size - len(SPECIALS)
    best = word_counts(df, text).filter(F.col("n") >= min_frequency).orderBy(F.col("n").desc(), "word").limit(room)
    # At most ``size`` rows remain, the limit being what a vocabulary size means.
    ranked = best.select(
        (F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) + len(SPECIALS) - 1).alias("id"), "word", "n"
    )
    specials = df.sparkSession.createDataFrame(
        [(i, w, 0) for i, w in enumerate(SPECIALS)], "id int, word string, n long"
    )
    return specials.unionByName(ranked)


def rare_words(df: DataFrame, text: str = "norm", percentile: float = 10.0) -> DataFrame:
    """Words whose frequency is at most the given percentile of all word frequencies."""
    counts = checkpointed(word_counts(df, text))  # read for the limit and for the words below it
    limit = quantile_list(counts, F.col("n"), [percentile / 100])
    return counts.filter(F.col("n") <= (limit[0] if limit else 0.0))


def templates(df: DataFrame, text: str = "norm", *, min_frequency: int = 10) -> DataFrame:
    """Texts that occur at least ``min_frequency`` times."""
    return df.groupBy(text).agg(F.count("*").alias("n")).filter(F.col("n") >= min_frequency)
