"""Sliding medians, kept sketches and learned pieces against plain Python."""

import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from omenlog.operators import medians, pieces, report, sketch
from omenlog.operators.order import Order
from omenlog.operators.scores import change_score
from omenlog.session import new_folder


def plain_median(values):
    known = sorted((v != v, v) for v in values if v is not None)
    return statistics.median([v for _, v in known]) if known else None


@pytest.mark.parametrize("window", [1, 2, 7, 100])
def test_running_median(window):
    draw = np.random.default_rng(window)
    values = [None if x < 1 else float(x) for x in draw.integers(0, 9, size=300)]
    known = np.array([v is not None for v in values])
    first = np.maximum(np.arange(300) - window + 1, 0)
    got = medians.running_median(np.array([v or 0.0 for v in values]), known, first)
    for i in range(300):
        want = plain_median(values[first[i] : i + 1])
        assert (want is None and np.isnan(got[i])) or got[i] == want


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_median_over_blocks(spark, keys):
    draw = np.random.default_rng(3)
    rows = [(i, i // 2, None if s > 80 else float(s), int(k), dt.datetime(2024, 1, 1), "x")
            for i, (s, k) in enumerate(zip(draw.integers(0, 100, size=400), draw.integers(0, 3, size=400)))]
    df = spark.createDataFrame(rows, "line_id long, us long, score double, key int, `when` timestamp, pos string")
    got = medians.with_median(df, 11, order=Order(keys, ("us", "line_id")), block_rows=40)
    assert got.columns == [*df.columns, "_n", "_base"]
    seen, want = {}, {}
    for i, _, s, k, _, _ in rows:
        mine = seen.setdefault(k if keys else 0, [])
        mine.append(s)
        want[i] = (len(mine[-11:]), plain_median(mine[-11:]))
    assert {r["line_id"]: (r["_n"], r["_base"]) for r in got.collect()} == want
    assert medians.with_median(df.limit(0), 11, order=Order(keys, ("us", "line_id"))).count() == 0


def test_change_score_of_a_window_longer_than_the_table(spark):
    df = spark.createDataFrame([(i, i, float(i)) for i in range(9)], "line_id long, us long, score double")
    assert {r["line_id"]: r["delta_score"] for r in change_score(df, 5000).collect()} == {i: float(i) for i in range(9)}
    with pytest.raises(ValueError):
        change_score(df, 3, "mode")


def test_sketches_of_days_are_kept_merged_and_replaced(spark):
    draw = np.random.default_rng(5)
    rows = [(i % 4, i % 2, float(x)) for i, x in enumerate(draw.lognormal(size=40_000))] + [(0, 0, None), (0, 1, float("nan"))]
    df = spark.createDataFrame(rows, "d int, key int, score double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    folder = new_folder(spark, "sketches")
    for load in (df.filter("d < 2"), df.filter("d = 2"), df.filter("d = 3"), df.filter("d = 2")):
        sketch.keep_days(sketch.daily(load, F.col("score"), F.col("day"), keys=["key"]), folder)
    days = sketch.kept_days(spark, folder)
    assert days.count() == 4
    probs = [0.01, 0.5, 0.95, 0.999]
    for r in sketch.quantiles(days, probs, keys=["key"]).collect():
        values = np.array([x for _, k, x in rows if k == r["key"] and x is not None and x == x])
        assert r["n"] == len(values)
        assert abs((values <= r["value"]).mean() - probs[r["q"]]) <= 0.01
    first = sketch.quantiles(days.filter("day = date'2024-01-01'"), [0.5]).first()
    assert first["n"] == 10_000
    assert sketch.quantiles(days.limit(0), probs).count() == 0 and sketch.rank_error() < 0.01


def test_longest_piece_first(spark):
    trie = pieces.Trie([("ab", 5), ("abc", 6), ("c", 7), ("d", 8), ("a", 9), ("b", 10)])
    assert trie.cut("abcd") == [6, 0, 3, 8, 3, 4]
    assert trie.cut("abab") == [5, 0, 2, 5, 2, 4] and trie.cut("ba") == [10, 0, 1, 9, 1, 2]
    assert trie.cut("abx") == [pieces.UNKNOWN, 0, 3] and trie.cut("") == []
    known = spark.createDataFrame([("ab", 5), ("c", 7)], "piece string, id long")
    df = spark.createDataFrame([(["abc", None, "", "zz" * 5000],), (None,), ([],)], "w array<string>")
    got = [r["p"] for r in df.select(pieces.cut(F.col("w"), known).alias("p")).collect()]
    assert [[tuple(x) for x in w] for w in got[0]] == [[(5, 0, 2), (7, 2, 3)], [], [], [(1, 0, 10_000)]]
    assert got[1:] == [None, []]


def test_learned_pieces_cut_the_words_they_come_from(spark):
    df = spark.createDataFrame([("disk full",), ("disk error",), ("full disk",)], "norm string")
    known = {r["piece"]: r["id"] for r in pieces.learned(df, size=6).collect()}
    assert known == {"disk": 5, "d": 6, "i": 7, "k": 8, "s": 9}
    assert pieces.learned(df.limit(0)).count() == 0


def test_headline_of_missing_figures(spark):
    row = spark.sql("""SELECT named_struct('f1', 0.5D, 'auroc', CAST(NULL AS DOUBLE)) AS quality, 'not ready' AS recommendation,
      named_struct('ewr_5min', CAST('NaN' AS DOUBLE), 'mean_dlt', 90.0D) AS lead_time,
      named_struct('roi_percentage', CAST('Infinity' AS DOUBLE), 'net_benefit', -1234567.0D) AS roi""")
    assert tuple(report.headline(row).first()) == (
        "F1=0.500, AUROC=n/a", "EWR(5min)=n/a%, Mean DLT=1.5min", "ROI=inf%, Net Benefit=$-1,234,567", "not ready")
