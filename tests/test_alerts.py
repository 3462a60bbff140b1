"""Anchored windows, lead times and sweeps with many buckets against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omenlog.operators import alerts, leadtime, sweep
from omenlog.operators.order import Order
from omenlog.schema import SECOND
from tests.test_order import stream


def scan(us, width):
    starts, start = [], None
    for t in us:
        if start is None or t - start > width:
            start = t
        starts.append(start)
    return starts


@pytest.mark.parametrize("keys", [(), ("key",)])
@pytest.mark.parametrize("width", [3, 120, 5000])
def test_anchored_groups(spark, keys, width):
    pdf = stream(400, seed=3)
    out = alerts.anchored_groups(
        spark.createDataFrame(pdf), width / SECOND, keys=keys, ranges=9
    ).toPandas().sort_values([*keys, "us", "line_id"])
    want = pdf.sort_values([*keys, "us", "line_id"])
    if keys:
        want["w"] = np.concatenate([scan(g["us"], width) for _, g in want.groupby("key")])
    else:
        want["w"] = scan(want["us"], width)
    assert len(out) == len(want)
    assert (out["window_start"].to_numpy() == want["w"].to_numpy()).all()


def test_window_end_is_inclusive(spark):
    rows = [(1, 0, 1.0, 1), (2, 300 * SECOND, 2.0, 0), (3, 300 * SECOND + 1, 3.0, 0)]
    df = spark.createDataFrame(rows, "line_id long, us long, score double, label int")
    groups = alerts.group_summary(alerts.anchored_groups(df, 300)).orderBy("window_start").collect()
    assert [(g.alert_count, g.tp, g.fp) for g in groups] == [(2, 1, 1), (1, 0, 1)]


def test_no_alerts(spark):
    df = spark.createDataFrame([], "line_id long, us long, ts timestamp, score double, label int")
    groups = alerts.group_summary(alerts.anchored_groups(df, 300))
    assert groups.count() == 0
    row = alerts.group_metrics(groups).first()
    assert (row.total_alerts, row.total_groups, row.reduction_pct, row.avg_per_group) == (0, 0, 0.0, 0.0)


def brute_lead(pdf, threshold, mode, rows=50, width=900):
    pdf = pdf.sort_values(["us", "line_id"]).reset_index(drop=True)
    out = {}
    for i in np.flatnonzero(pdf["label"] == 1):
        t = pdf["us"][i]
        if mode == "last":
            hits = [pdf["us"][j] for j in range(i) if pdf["score"][j] >= threshold][-1:]
        elif mode == "within":
            hits = [u for u, s in zip(pdf["us"], pdf["score"]) if s > threshold and t - width <= u < t]
        else:
            hits = [pdf["us"][j] for j in range(max(0, i - rows), i) if pdf["score"][j] > threshold]
        first = (hits[-1] if mode == "last" else min(hits)) if hits else None
        out[pdf["line_id"][i]] = 0.0 if first is None else max(0.0, (t - first) / SECOND)
    return out


@pytest.mark.parametrize("mode", ["last", "within", "rows"])
@pytest.mark.parametrize("keys", [(), ("key",)])
def test_lead_time(spark, mode, keys):
    pdf = stream(300, seed=5)
    df = spark.createDataFrame(pdf)
    order = Order(keys, ranges=9)
    # `within` counts seconds; the fixture's instants are microseconds
    scaled = df.withColumn("us", F.col("us") * SECOND) if mode == "within" else df
    out = leadtime.lead_time(scaled, 9.0, mode, keys=keys, rows=50, seconds=900, order=order).toPandas()
    got = dict(zip(out["line_id"], out["dlt"]))
    parts = [g for _, g in pdf.groupby("key")] if keys else [pdf]
    want = {}
    for g in parts:
        found = brute_lead(g, 9.0, mode)
        want.update({k: v * SECOND if mode == "within" else v for k, v in found.items()})
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_sensitivity_matches_each_threshold(spark):
    pdf = stream(300, seed=6)
    pdf["us"] *= SECOND
    df = spark.createDataFrame(pdf)
    grid = [0.5, 3.0, 8.0, 8.0, 1000.0]
    table = leadtime.sensitivity(df, grid, order=Order(ranges=9)).toPandas().sort_values("q")
    assert list(table["q"]) == [0, 1, 2, 3, 4]
    for r in table.itertuples():
        dlt = np.array(list(brute_lead(pdf, r.threshold, "rows", rows=1000).values()))
        assert r.ewr == pytest.approx((dlt >= 300).mean() * 100)
        assert r.mean_dlt == pytest.approx(dlt.mean())
        assert r.median_dlt == pytest.approx(np.median(dlt))
        assert r.max_dlt == pytest.approx(dlt.max())
        hit = pdf["score"] > r.threshold
        assert (r.tp, r.fp) == ((hit & (pdf.label == 1)).sum(), (hit & (pdf.label == 0)).sum())


def test_sensitivity_in_arrival_order_and_by_session(spark):
    """An alert that arrives after the failure is no warning, whatever its time; nor is another session's."""
    pdf = stream(200, seed=8)
    pdf["us"] *= SECOND
    df = spark.createDataFrame(pdf)
    for keys in ((), ("key",)):
        order = Order(keys, ("line_id",), ranges=9)
        table = leadtime.sensitivity(df, [3.0, 8.0], keys=keys, order=order).toPandas().sort_values("q")
        for r in table.itertuples():
            dlt = leadtime.lead_time(df, r.threshold, "rows", keys=keys, order=order).toPandas()["dlt"]
            assert r.mean_dlt == pytest.approx(dlt.mean()) and r.max_dlt == pytest.approx(dlt.max())
            assert r.median_dlt == pytest.approx(dlt.median())


def test_pareto_front_keeps_undominated_rows(spark):
    rows = [(0, 0.9, 10.0), (1, 0.8, 20.0), (2, 0.7, 15.0), (3, 0.9, 10.0)]
    table = spark.createDataFrame(rows, "q int, f1 double, ewr double")
    assert sorted(r.q for r in leadtime.pareto_front(table, ["f1", "ewr"]).collect()) == [0, 1, 3]


def test_no_early_warning_is_a_failed_search(spark):
    rows = [(0, 1.0, 0.0, 0.0, 0.5, 0.1, 0.1, 0.0), (1, 2.0, 0.0, 0.0, 0.4, 0.1, 0.1, 0.0)]
    table = spark.createDataFrame(
        rows, "q int, threshold double, ewr double, fpr double, f1 double, precision double, recall double, mean_dlt double"
    )
    row = leadtime.best_early_threshold(table).first()
    assert (row.status, row.best_threshold, row.f1_threshold, row.feasible) == ("failed", 2.0, 1.0, 2)


def test_constant_scores(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "score double, label int")
    out = sweep.sweep(df, sweep.linear_thresholds(df, 10), strict=False).toPandas()
    assert len(out) == 10 and (out["tp"] == 1).all() and (out["fp"] == 1).all()


def test_value_without_false_alarms(spark):
    df = spark.createDataFrame([(400.0,), (500.0,), (0.0,)], "dlt double")
    row = leadtime.value_of(df, F.lit(0)).first()
    assert row.prevented == 1 and row.roi_ratio == float("inf") and row.roi_percentage == float("inf")


@pytest.mark.parametrize("ranges, block_rows", [(9, 16), (1, 8192)])
@pytest.mark.parametrize("keys", [(), ("key",)])
def test_lead_steps(spark, keys, ranges, block_rows):
    """Every threshold of every failure against a look at the rows before it; nulls, NaN, ties, unsorted thresholds."""
    rng = np.random.default_rng(12)
    n, rows = 150, 11
    pdf = pd.DataFrame({
        "line_id": np.arange(n), "key": rng.integers(0, 3, n), "us": rng.integers(0, 400, n) * SECOND,
        "label": np.where(rng.random(n) < 0.3, 1, 0), "score": np.round(rng.exponential(3, n), 0),
    })
    data = [(*r[:4], None if r[0] % 17 == 0 else float("nan") if r[0] % 29 == 0 else r[4]) for r in pdf.itertuples(index=False, name=None)]
    df = spark.createDataFrame(data, "line_id long, key long, us long, label int, score double")
    grid = [4.0, 0.0, 7.5, 2.0, 2.0, 50.0]
    got = leadtime.lead_steps(df, grid, keys=keys, rows=rows, order=Order(keys, ranges=ranges), block_rows=block_rows).collect()
    assert got[0].asDict().keys() == {*keys, "line_id", "low", "high", "lead_us"}
    have = {}
    for r in got:
        for rank in range(r.low, r.high):
            assert (r.line_id, rank) not in have
            have[r.line_id, rank] = r.lead_us
    groups, want = {}, {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1] if keys else 0, []).append(r)
    for group in groups.values():
        for i, row in enumerate(group):
            for rank, t in enumerate(sorted(grid)):
                if row[3] == 1:
                    hits = [e[2] for e in group[max(0, i - rows):i] if e[4] is not None and (e[4] > t or e[4] != e[4])]
                    want[row[0], rank] = row[2] - hits[0] if hits else 0
    assert have == want


def test_sensitivity_without_failures(spark):
    df = spark.createDataFrame([(i, i * SECOND, 0, float(i)) for i in range(20)], "line_id long, us long, label int, score double")
    for medians in (True, False):
        rows = leadtime.sensitivity(df, [3.0, 8.0], medians=medians).collect()
        assert [(r.ewr, r.mean_dlt, r.max_dlt) for r in rows] == [(0.0, 0.0, 0.0)] * 2
