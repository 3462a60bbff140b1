"""Steps whose seconds a GB decide on larger tables."""

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from omenlog.functions import normalise as nz
from omenlog.operators import blends, surprise, sweep, synthetic
from omenlog.plans import load
from omenlog.streaming import run

QUERIES = load()

PARTS = [
    "Jan 3 ", "January  12 ", "2005.11.09 ", "12:01:02", "user@host-1a", "a.b@c", "x-y.z", "DATE ab", "0123abcdef99", "[123]", " (", "] ",
    "※", "ㆍ", "\t", " ", "\x85", "é", "İ", "K", "Å", "ß", "한", "é", "٠١", "blk_-12", "10.1.2.3:80", "<a>",
    "\\", "'", "…", "\n", " ", "x", "Y", "\U0001f600", "日", "\\1", "$1", "\x1c", "Σ",
]


@pytest.mark.parametrize("name", ["generic", "hdfs", "thunderbird"])
def test_batches_of_lines_give_the_templates_of_the_jvm(spark, name):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))) for i in range(3000)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, "")], "id long, raw string")
    both = df.select("raw", nz.normalise(F.col("raw"), name).alias("a"), nz.PROFILES[name].template(F.col("raw")).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_bytes_that_are_no_text_become_blanks(spark):
    raw = F.concat(F.lit("ab é"), F.unhex(F.lit("FF")).cast("string"), F.lit("cd"))
    assert spark.range(1).select(nz.normalise(raw).alias("n")).first()["n"] == "ab e cd"


@pytest.mark.parametrize("name", ["normalise_generic", "normalise_hdfs", "normalise_thunderbird"])
def test_templates_are_made_in_batches(spark, name):
    """Chains of interpreted regular expressions took four times as long."""
    plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


@pytest.mark.parametrize("shape", ["even", "few", "skewed", "one"])
def test_blends_are_counted_without_a_row_per_alpha(spark, monkeypatch, shape):
    """Exact quantiles, counts and areas of every blend, with ties, outliers and nulls."""
    monkeypatch.setattr(blends, "CANDIDATES", 50)
    monkeypatch.setattr(blends, "PART_ROWS", 400)
    rng, size, alphas = np.random.default_rng(3), 1500, [0.0, 0.3, 1.0]
    a, b = rng.random(size), rng.random(size)
    if shape == "few":
        a, b = np.round(a * 3), np.round(b * 2)
    if shape == "skewed":
        a, b = a ** 9, b * 1e-6
        a[0] = b[1] = 1e6
    if shape == "one":
        a, b = np.ones(size), np.ones(size)
    label = (rng.random(size) < 0.3).astype(int)
    rows = [(float(x), float(y), int(k)) for x, y, k in zip(a, b, label)] + [(None, 1.0, 1), (2.0, None, 0)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    pairs = sweep.equal_pairs(df, F.col("a"), F.col("b"))
    probs = sweep.percentile_grid(0, 100, 101)
    found = blends.quantiles(pairs, alphas, probs)
    counts = {(r["alpha_no"], r["b"]): (r["pos"], r["neg"]) for r in blends.passed(pairs, alphas, {i: [0.2, 0.5] for i in range(3)}, True).collect()}
    areas = {r["alpha_no"]: r["auroc"] for r in blends.auroc(pairs, alphas).collect()}
    for i, x in enumerate(alphas):
        v = x * a + (1.0 - x) * b
        assert found[i] == pytest.approx(np.quantile(v, probs), rel=1e-12, abs=1e-15)
        for k in range(3):
            here = (v > 0.2).astype(int) + (v > 0.5) == k
            want = (int((here & (label == 1)).sum()) + (k == 0), int((here & (label == 0)).sum()) + (k == 0))
            assert counts.get((i, k), (0, 0)) == want
        low = v.min() - 1  # the two unknown ones
        above = np.sign(np.append(v[label == 1], low)[:, None] - np.append(v[label == 0], low)[None, :])
        assert areas[i] == pytest.approx(((above + 1) / 2).mean(), abs=1e-12)


def test_blends_of_infinite_scores_are_sorted_whole(spark):
    df = spark.createDataFrame([(float("inf"), 0.5, 1), (0.1, 0.2, 0), (0.4, 0.1, 1)], "a double, b double, label int")
    pairs = sweep.equal_pairs(df, F.col("a"), F.col("b"))
    assert blends.quantiles(pairs, [0.5], [0.5]) is None and blends.auroc(pairs, [0.5]) is None
    assert sweep.best_alpha(pairs, [0.5, 1.0]).count() == 2


def test_best_alpha_copies_no_rows(spark, monkeypatch):
    """A row per alpha was grouped, sorted and searched before."""
    monkeypatch.setattr(sweep, "_mixed", None)
    assert QUERIES["best_alpha_online"].run(spark, "/root/testdata/sf0.001").count() == 11


def test_words_are_counted_in_batches(spark):
    """No text is grouped before its words are counted."""
    rows = ["a b a", "a b a", "", "  c\tb\x0bd ", None, "é"]
    df = spark.createDataFrame([(t,) for t in rows], "norm string")
    counts = surprise.word_counts(df)
    assert {r["word"]: r["n"] for r in counts.collect()} == {"a": 4, "b": 3, "c": 1, "d": 1, "é": 1}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_tokens_are_shuffled_by_their_tickets(spark):
    rows = [(1, ["a", "[CLS]", "b", "c", "d", "[SEP]"]), (2, []), (3, None), (None, ["x", "y", "z"]), (5, ["p", None, "q"]), (6, ["r"] * 400 + ["s"])]
    df = spark.createDataFrame(rows, "id long, w array<string>").coalesce(1)
    out = df.select("id", synthetic.shuffled(F.col("w"), F.col("id")).alias("x"))
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    for (n, w), got in zip(rows, out.collect()):
        if w is None:
            assert got["x"] is None
            continue
        place = [i for i, t in enumerate(w) if t and t not in synthetic.SPECIAL]
        name = "42|shuffle|" + ("" if n is None else f"{n}|")
        want = dict(zip(place, [
            t for _, t in sorted((md5(f"{name}{i}".encode()).hexdigest()[:15], w[i]) for i in place)]))
        assert got["x"] == [want.get(i, t) for i, t in enumerate(w) if t is not None]


def test_slices_of_many_rows_arrive_in_several_files(spark, monkeypatch):
    """A slice was filtered and written by one task that read all rows."""
    df = spark.range(600, numPartitions=3).selectExpr(
        "id AS line_id", "id * 1000000 AS us", "timestamp_micros(id * 1000000) AS ts", "id % 2 AS key")
    monkeypatch.setattr(run, "FILE_ROWS", 40)
    files = run.files_of(df)
    path, _ = run.staged(df, files=files)
    there = spark.read.parquet(path)
    assert files == 3 and len(there.inputFiles()) == 7 * 3 + 1
    assert sorted(r["line_id"] for r in there.collect() if r["line_id"] is not None) == list(range(600))
