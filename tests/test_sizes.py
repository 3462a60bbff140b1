"""What only shows on larger tables, on small ones made for it."""

import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from omenlog import session
from omenlog.functions import normalise as nz
from omenlog.functions import words
from omenlog.operators import positions, split, surprise, sweep, synthetic
from omenlog.plans import load

QUERIES = load()


@pytest.mark.parametrize("rows", [10_000, 6_000_000, 6_000_007, 3_000_000_010])
def test_cuts_follow_the_written_share(spark, rows):
    """As DuckDB's decimals do; a product of doubles rounds 4,799,999.9999999994 up."""
    shares = {"a": 0.7, "b": 0.7 + 0.1, "c": 0.25}
    got = spark.range(1).select(*[split._cut(F.lit(rows), s).alias(n) for n, s in shares.items()]).first()
    assert (got["a"], got["b"], got["c"]) == (rows * 7 // 10, rows * 7999999999999999 // 10**16, rows // 4)


@pytest.fixture(scope="module")
def late_documents(spark, tmp_path_factory):
    """Documents whose line ids, counted in microseconds, leave the range of a long."""
    folder = str(tmp_path_factory.mktemp("late-documents"))
    rows = [(4_300 + i, f"alpha beta {'gamma' if i % 3 else 'delta'} x\nbeta alpha {'abcdefgh'[i % 8]} end", "s") for i in range(40)]
    rows.append((4_000_000_000, "alpha beta\nbeta alpha", "s"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4_301, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_line_scoring_of_high_document_numbers(spark, late_documents):
    base = QUERIES["baseline_line_scoring"].run(spark, late_documents).toPandas()
    full = QUERIES["full_line_scoring"].run(spark, late_documents).toPandas()
    assert len(base) == len(full) == 82 and base["line_id"].is_unique
    delta = full.sort_values("line_id")["log_delta"].to_numpy()
    assert delta[0] == 0 and delta[1] == pytest.approx(6.908754779)  # a second after the line before
    assert delta[2] == pytest.approx(28.395, abs=0.01)  # 2 ** 31 - 1 seconds later


@pytest.mark.parametrize("often", [1, 3, 1_000_000])
def test_surprise_moves_each_position_once(spark, monkeypatch, often):
    """Pairs counted apart and pairs in one task give the counts of plain Python."""
    from collections import Counter

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(1, 7), p=[0.5, 0.2, 0.1, 0.1, 0.1])) for _ in range(150)]
    normal, new = texts[:100], [*texts[90:], "a z a", "z y", "y"]
    monkeypatch.setattr(surprise, "SAMPLED", 1)
    monkeypatch.setattr(surprise, "FREQUENT", often)
    model = surprise.train(spark.createDataFrame([(t,) for t in normal], "norm string"))
    lines = spark.createDataFrame(list(enumerate(sorted(set(new)))), "line_no long, norm string")
    got = {(r["line_no"], r["pos"]): (r["word"], r["err"], r["prob"]) for r in surprise.word_scores(model, lines).collect()}

    def cut(t):
        w = ["<s>", *t.split(), "</s>"]
        return list(zip(w[1:], w, w[2:]))

    rows = [c for t in normal for c in cut(t)]
    levels = [(Counter((w, *k(w, a, b)) for w, a, b in rows), k) for k in (
        lambda w, a, b: (a, b), lambda w, a, b: (a,), lambda w, a, b: ())]
    room, want = 0.1 * (len({w for w, _, _ in rows}) + 1), {}
    for n, t in enumerate(sorted(set(new))):
        for i, (w, a, b) in enumerate(cut(t)):
            for counts, k in levels:
                here = {x[0]: c for x, c in counts.items() if x[1:] == k(w, a, b)}
                if here:
                    total = sum(here.values()) + room
                    want[n, i] = (w, -np.log((here.get(w, 0) + 0.1) / total), 1 - (max(here.values()) + 0.1) / total)
                    break
    assert got.keys() == want.keys()
    for at, (w, err, prob) in want.items():
        assert got[at][0] == w and got[at][1:] == pytest.approx((err, prob))


def test_surprise_shuffles_positions_once(spark):
    """One exchange of the positions for all counts; tables of triples moved them four times and more."""
    df = spark.createDataFrame([("a b c", 1)], "line string, key long").withColumn("copies", F.lit(1))
    plan = surprise.counted(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_positions_move_in_blocks(spark):
    """A position takes a few bytes on its way to the task of its pair; as a row with its words it took about forty."""
    rng = np.random.default_rng(3)
    vocabulary = [f"word{chr(97 + i % 26)}{i}" for i in range(3000)]
    texts = [" ".join(vocabulary[min(2999, int(w))] for w in rng.pareto(1.0, 50) * 20) for _ in range(400)]
    df = spark.createDataFrame([(i, 1, t.split()) for i, t in enumerate(texts)], "key long, copies long, words array<string>").coalesce(1)
    blocks = df.mapInArrow(positions.cut(4, positions.Frequent()), positions.MOVED)
    size = blocks.agg(F.sum(F.length("block"))).first()[0]
    assert size < 12 * 400 * 50


def test_letters_and_angles_are_one_class(spark):
    """The profiles' pattern removes what ``[^a-zA-Z<>]+`` removes, and does not take its time."""
    texts = ["", "<a> b==<<c;>>1 d\n\te", "é<è>ß 日本 <x> \U0001f600", "-" * 50_000 + "z", " ".join(["plain words, 12 <NUM>"] * 4_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.regexp_replace("t", F.lit(nz.LETTERS_AND_ANGLES), F.lit(" "))).collect()
    assert [r[0] for r in got] == [re.sub(r"[^a-zA-Z<>]+", " ", t) for t in texts]
    long = spark.range(1000, numPartitions=1).select(F.concat(F.repeat(F.lit("plain words, 12 <NUM> "), 400), F.col("id")).alias("t"))

    def seconds(pattern):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            long.select(F.regexp_replace("t", F.lit(pattern), F.lit(" "))).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    assert seconds(nz.LETTERS_AND_ANGLES) < 0.6 * seconds(r"[^a-zA-Z<>]+")


@pytest.mark.parametrize("name", [
    "rare_words", "augmented_lines", "augmented_by_replacement", "rare_word_insertions", "line_embeddings", "learned_pieces",
])
def test_templates_are_made_once(spark, name):
    """The lines are normalised into a table that all steps read, not anew for each of them."""
    plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_tickets_sort_as_their_draws(spark):
    rows = spark.range(500).select(synthetic.ticket(42, "x", F.col("id")).alias("t"), synthetic.draw(42, "x", F.col("id")).alias("d")).collect()
    assert [r["d"] for r in sorted(rows, key=lambda r: r["t"])] == sorted(r["d"] for r in rows)


def test_windows_of_a_batch_are_flat_arrays(spark):
    """Null, empty and long texts; no Python object for each text of a batch."""
    df = spark.createDataFrame([(1, ["a", "b", "c"] * 400), (2, []), (3, None), (4, ["a"])], "id int, w array<string>")
    placed = df.select("id", words.windows(F.col("w"), 5).alias("win"))
    got = {r["id"]: r["win"] for r in placed.collect()}
    assert got == {1: [i // 5 for i in range(1200)], 2: [], 3: None, 4: [0]}
    assert "pack(" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_equal_rows_are_blended_once(spark):
    """Copies of a row are counted before they are blended with every alpha."""
    df = spark.range(3000).select((F.col("id") % 3 / 2).alias("a"), (F.col("id") % 2).cast("double").alias("b"), (F.col("id") % 2).alias("label"))
    mixed = sweep.by_alpha(df, F.col("a"), F.col("b"), [0.0, 0.5, 1.0])
    assert mixed.count() == 18 and mixed.agg(F.sum("n")).first()[0] == 9000


def shuffle_files(spark):
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for folder in folders for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_written_steps_leave_no_shuffle_files(spark):
    """The disk is free again when a step is written, not when the driver collects its garbage."""
    before = shuffle_files(spark)
    step = session.checkpointed(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and step.count() == 7
    assert spark.conf.get(session.CLEANUP, None) != "true"


def test_passing_tables_are_removed(spark):
    with session.passing(spark) as step:
        table = step(spark.range(10))
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 10 and os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


@pytest.mark.parametrize("name", ["surprise_quality", "surprise_quality_by_k", "line_surprise", "full_line_scoring", "stream_line_scores"])
def test_texts_go_when_they_are_scored(spark, name):
    """No table of texts stays beside the blocks of positions until the result is written."""
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    assert QUERIES[name].run(spark, "/root/testdata/sf0.001").count()
    tables = [f"{shared}/{d}" for d in set(os.listdir(shared)) - before if d.startswith(("step", "passing"))]
    assert tables and not [t for t in tables if {"norm", "line"} & set(spark.read.parquet(t).columns)]


def test_turns_share_the_positions(spark):
    """Each pair is counted in one of the turns, and one turn moves a part of the positions."""
    df = spark.range(300).selectExpr("id AS key", "concat('a', id % 7, ' b', id % 5, ' c', id % 3, ' d') AS line", "1L AS copies")

    def answered(**turn):
        blocks = surprise.counted(df, parts=8, **turn).filter("block is not null").collect()
        return sum(len(positions._unpacked(pa.scalar(r["block"], pa.binary()))["pos"]) for r in blocks)

    turns = [answered(turn=t, turns=2) for t in range(2)]
    assert sum(turns) == answered() == 1200 and all(turns)


def test_word_scores_move_texts_not_arrays(spark):
    """The signals of a line, two doubles a word, stay where they are made; the texts come there."""
    model = surprise.train(spark.createDataFrame([("a b c",), ("a c",)], "norm string"))
    lines = spark.createDataFrame([(1, "a b"), (2, "")], "line_no long, norm string")
    got = surprise.word_scores(model, lines)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["line_no"], r["pos"], r["word"]) for r in got.orderBy("pos").collect()] == [(1, 0, "a"), (1, 1, "b")]
