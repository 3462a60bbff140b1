"""Bucketed scans against plain pandas, with a hot key, hot instants and small buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omenlog.operators import order as o


def stream(n=600, seed=1, keys=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "line_id": rng.permutation(n),
        # key 0 holds more than a third of the rows, and so does one instant
        "key": np.where(rng.random(n) < 0.4, 0, rng.integers(0, keys, n)),
        "us": np.where(rng.random(n) < 0.35, 5000, rng.integers(0, 10_000, n)),
        "score": np.round(rng.exponential(5, n), 2),
        "label": (rng.random(n) < 0.2).astype(int),
    })
    return pdf


@pytest.fixture(scope="module")
def pdf():
    return stream()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def ordered(pdf, keys):
    return pdf.sort_values([*keys, "us", "line_id"]).reset_index(drop=True)


@pytest.mark.parametrize("ranges", [1, 9])
@pytest.mark.parametrize("keys", [(), ("key",)])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(df, pdf, ranges, keys, reverse, exclusive):
    big = F.when(F.col("score") > 5, F.col("line_id"))
    out = o.running(
        df, o.Order(keys, ranges=ranges),
        {"s": ("sum", F.col("label")), "lo": ("min", F.col("score")), "hi": ("max", F.col("score")),
         "last": ("last", big), "first": ("first", big)},
        reverse=reverse, exclusive=exclusive,
    ).toPandas().set_index("line_id").sort_index()
    want = ordered(pdf, keys)
    if reverse:
        want = want.iloc[::-1]
    want["one"] = 1
    grouped = [g for _, g in want.groupby(list(keys))] if keys else [want]
    for g in grouped:
        picked = []
        s = lo = hi = last = first = None
        for r in g.itertuples():
            state = (s, lo, hi, last, first)
            s = (s or 0) + r.label
            lo = r.score if lo is None else min(lo, r.score)
            hi = r.score if hi is None else max(hi, r.score)
            if r.score > 5:
                last = r.line_id
                first = r.line_id if first is None else first
            picked.append(state if exclusive else (s, lo, hi, last, first))
        got = out.loc[g["line_id"], ["s", "lo", "hi", "last", "first"]]
        expected = pd.DataFrame(picked, columns=got.columns, index=got.index)
        pd.testing.assert_frame_equal(got.astype(float), expected.astype(float), check_dtype=False)


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_ordinal(df, pdf, keys):
    out = o.ordinal(df, o.Order(keys, ranges=9)).toPandas().set_index("line_id")["pos"]
    want = ordered(pdf, keys)
    want["pos"] = want.groupby(list(keys)).cumcount() if keys else range(len(want))
    assert (out.loc[want["line_id"]].to_numpy() == want["pos"].to_numpy()).all()


def test_ranges_split_hot_keys_and_instants(df):
    order = o.Order(("key",), ranges=9)
    sizes = o.laid_out(df, order).groupBy(order.range).count().toPandas()["count"]
    assert len(sizes) == 9 and sizes.max() < 150


def test_rows_laid_out_are_not_moved_again(df):
    order = o.Order(("key",), ranges=9)
    laid = o.laid_out(df, order)
    assert o.laid_out(laid, order) is laid
    out = o.ordinal(laid, order)
    assert order.range in out.columns and order.range not in o.ordinal(df, order).columns
    plan = o.ordinal(df, o.Order(ranges=9))._jdf.queryExecution().executedPlan().toString().splitlines()
    # only totals of the ranges meet in one task
    assert all("HashAggregate" in plan[i + 1] for i, line in enumerate(plan) if "SinglePartition" in line)


@pytest.mark.parametrize("keys", [(), ("key",)])
@pytest.mark.parametrize("ranges", [1, 9])
def test_lookback(df, pdf, keys, ranges):
    frame, w, finish = o.lookback(df, o.Order(keys, ranges=ranges), 7, block_rows=20)
    out = finish(frame.withColumn("m", F.max("score").over(w.rowsBetween(-7, -1)))).toPandas()
    assert len(out) == len(pdf)
    want = ordered(pdf, keys)

    def previous(s):
        return s.shift(1).rolling(7, min_periods=1).max()

    want["m"] = want.groupby(list(keys))["score"].transform(previous) if keys else previous(want["score"])
    got = out.set_index("line_id").loc[want["line_id"], "m"].to_numpy()
    np.testing.assert_allclose(got.astype(float), want["m"].to_numpy(), equal_nan=True)


@pytest.mark.parametrize("keys", [(), ("key",)])
@pytest.mark.parametrize("ranges", [1, 9])
def test_first_at_or_after_and_count_before(df, pdf, keys, ranges):
    probes = df.select(*keys, "line_id", (F.col("us") - 700).alias("at"))
    marks = df.filter("label = 1").select(*keys, F.col("us").alias("at"))
    hit = o.first_at_or_after(probes, marks, {"hit": F.col("at")}, keys=keys, ranges=ranges).toPandas()
    cnt = o.count_before(probes, marks, keys=keys, ranges=ranges).toPandas().set_index("line_id")["n"]
    hit = hit.set_index("line_id")["hit"]
    for r in pdf.itertuples():
        same = pdf[(pdf.label == 1) & ((pdf.key == r.key) if keys else True)]
        later = same[same.us >= r.us - 700].us
        want = later.min() if len(later) else None
        got = hit.loc[r.line_id]
        assert (want is None and pd.isna(got)) or got == want
        assert cnt.loc[r.line_id] == (same.us < r.us - 700).sum()


@pytest.mark.parametrize("keys", [(), ("key",)])
@pytest.mark.parametrize("ranges", [1, 9])
def test_quantiles(df, pdf, keys, ranges):
    probs = [0.5, 0.0, 0.99, 1.0, 0.5, 0.123]
    out = o.quantiles(df, F.col("score"), probs, keys=keys, ranges=ranges).toPandas()
    groups = pdf.groupby(list(keys)) if keys else [((), pdf)]
    for k, g in groups:
        for q, p in enumerate(probs):
            found = out[(out.q == q) & ((out["key"] == k[0]) if keys else True)]["value"]
            assert len(found) == 1
            assert found.iloc[0] == pytest.approx(np.quantile(g["score"], p), abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "score double")
    assert o.quantile_list(empty, F.col("score"), [0.5]) == []
    assert o.quantiles(empty, F.col("score"), [0.5]).count() == 0


def test_blocks_are_bounded(df):
    out = o.blocks(df, o.Order(("key",), ranges=9), 9, 30).toPandas()
    assert out.groupby("_block").size().max() <= 39
    assert out["_own"].sum() == 600
    assert (out[out["_own"]].groupby("key")["_pos"].max() + 1 == out[out["_own"]].groupby("key").size()).all()
