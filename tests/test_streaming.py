"""Streams over several files against the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omenlog.operators import alerts, context, leadtime, scores, temporal
from omenlog.operators.order import Order
from omenlog.schema import SECOND
from omenlog.streaming import stateful as st
from omenlog.streaming import joins, windows
from omenlog.streaming.run import file_stream, run_available, staged

START = 1_704_067_200 * SECOND


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    n = 240
    us = START + np.sort(rng.choice(6 * 3600, n, replace=False)) * SECOND
    return pd.DataFrame({
        "line_id": np.arange(n), "key": rng.integers(0, 3, n), "us": us,
        "ts": pd.to_datetime(us, unit="us"), "score": np.round(rng.exponential(5, n), 2),
        "label": (rng.random(n) < 0.2).astype(int), "dist": rng.integers(-2, 9, n).astype(float),
        "vec": [v.tolist() for v in rng.normal(size=(n, 3))],
    })


@pytest.fixture(scope="module")
def batch(spark, rows):
    return spark.createDataFrame(rows)


@pytest.fixture
def stream(spark, batch, tmp_path):
    """The rows in four files, one per micro-batch, in order of time."""
    path = str(tmp_path / "in")
    for part in range(4):
        piece = batch.filter((F.col("line_id") >= part * 60) & (F.col("line_id") < part * 60 + 60))
        piece.coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, path, files_per_batch=1)


def same(left, right, column):
    a = left.select("line_id", column).toPandas().set_index("line_id")[column].sort_index()
    b = right.select("line_id", column).toPandas().set_index("line_id")[column].sort_index()
    assert list(a.index) == list(b.index)
    np.testing.assert_allclose(a.astype(float), b.astype(float), atol=1e-9, equal_nan=True)


def test_delta(stream, batch):
    out = run_available(st.stateful(
        stream.select("key", "line_id", "us"), st.DeltaMs(), "key long, line_id long, delta_ms double"), "t")
    same(out, temporal.delta_ms(batch, keys=["key"], by=["us", "line_id"]), "delta_ms")


def test_hybrid(stream, batch):
    out = run_available(st.stateful(
        stream.select("key", "line_id", "us", "score", "dist"), st.Hybrid(0.3), "key long, line_id long, hybrid double"), "t")
    same(out, scores.online_hybrid(batch, "score", "dist", 0.3, order=Order(("key",))), "hybrid")


def test_lead_time(stream, batch):
    out = run_available(st.stateful(
        stream.select("key", "line_id", "us", "score", "label"), st.LeadTime(8.0, 1800), "key long, line_id long, dlt double"), "t")
    same(out, leadtime.lead_time(batch, 8.0, "within", keys=["key"], seconds=1800), "dlt")


def test_memory(stream, batch):
    out = run_available(st.stateful(
        stream.select("key", "line_id", "us", "vec"), st.Memory(20, 4), "key long, line_id long, distance double"), "t")
    same(out, context.knn(batch, 20, 4, order=Order(("key",))), "distance")


def test_anchored_groups(stream, batch):
    width = 900
    out = run_available(st.stateful(
        stream.select("key", "line_id", "ts", "us", "score").withWatermark("ts", "0 seconds"),
        st.AnchoredGroups(4.0, width),
        "key long, window_start long, window_end long, alert_count long, max_score double, mean_score double",
        time_mode="EventTime"), "t")
    whole = alerts.group_summary(
        alerts.anchored_groups(batch.filter("score > 4.0"), width, keys=["key"]), keys=["key"])
    columns = ["key", "window_start", "window_end", "alert_count", "max_score"]
    got = {tuple(r) for r in out.select(*columns).collect()}
    want = {tuple(r) for r in whole.select(*columns).collect()}
    assert got <= want
    # only groups that the watermark has not passed yet may be missing
    last = batch.agg(F.max("us")).first()[0]
    assert all(start + width * SECOND >= last - 1800 * SECOND for _, start, *_ in want - got)
    assert len(got) > len(want) / 2


@pytest.fixture
def arriving(spark, batch):
    """The rows in four files and a late one, with the row that closes the stream; and how late rows may be."""
    path, late = staged(batch, slices=4, reach=3600)
    assert len(spark.read.parquet(path).inputFiles()) == 6
    return (lambda: file_stream(spark, path, path, files_per_batch=1)), late


def waiting(stream, late, processor, schema):
    rows = stream.withWatermark("ts", late).filter(windows.timely(F.col("line_id").isNotNull()))
    return run_available(st.stateful(rows, processor, schema, time_mode="EventTime"), "t")


def test_rows_wait_for_late_ones(arriving, batch):
    stream, late = arriving
    out = waiting(stream(), late, st.DeltaMs(wait=True), "key long, line_id long, delta_ms double")
    same(out, temporal.delta_ms(batch, keys=["key"], by=["us", "line_id"]), "delta_ms")
    out = waiting(stream(), late, st.Memory(20, 4, wait=True), "key long, line_id long, distance double")
    same(out, context.knn(batch, 20, 4, order=Order(("key",))), "distance")


def test_buckets_of_keys_give_what_keys_give(arriving, batch):
    """Two buckets for three keys: their rows wait together, their values stay apart."""
    stream, late = arriving

    def run(processor, schema):
        rows = stream().withWatermark("ts", late).filter(windows.timely(F.col("line_id").isNotNull()))
        return run_available(st.bucketed(rows, processor, schema, buckets=2), "t")

    out = run(st.Hybrid(wait=True), "key long, line_id long, hybrid double")
    same(out, scores.online_hybrid(batch, "score", "dist", 0.5, order=Order(("key",))), "hybrid")
    schema = "key long, window_start long, window_end long, alert_count long, max_score double, mean_score double"
    out = run(st.AnchoredGroups(4.0, 900, wait=True), schema)
    whole = alerts.group_summary(alerts.anchored_groups(batch.filter("score > 4.0"), 900, keys=["key"]), keys=["key"])
    columns = ["key", "window_start", "window_end", "alert_count", "max_score"]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


@pytest.mark.parametrize("metric", ["cosine", "mahalanobis", "statistics"])
def test_session_memory(arriving, batch, monkeypatch, metric):
    """Several calls per key, several stretches per call, an inverse kept from call to call."""
    stream, late = arriving
    monkeypatch.setattr(st.SessionMemory, "stretch", 7)
    order, schema = Order(("key",)), f"key long, line_id long, {st.SESSION_MEMORY[metric]}"
    out = waiting(stream(), late, st.SessionMemory(metric, 9, 4, 16, wait=True), schema)
    if metric == "cosine":
        same(out, context.cosine(batch, 9, 4, order=order), "distance")
    elif metric == "mahalanobis":
        same(out, context.mahalanobis(batch, 9, 4, 16, order=order), "distance")
    else:
        whole = context.memory_statistics(batch, 9, order=order)
        same(out, whole, "n")
        same(out, whole, "total_variance")
        same(*(t.withColumn("mean", F.coalesce(F.get("mean", F.lit(2)), F.lit(-9.0))) for t in (out, whole)), "mean")


def test_session_memory_leaves_out_rows_without_a_vector():
    with pytest.raises(ValueError):
        st.SessionMemory("euclid")

    class Kept:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)

    processor = st.SessionMemory("cosine", 3, 1)
    processor.state = Kept()
    rows = pd.DataFrame({"line_id": [1, 2, 3], "vec": [[1.0, 0.0], None, [0.0, 1.0]]})
    out = pd.concat(processor.advance((5,), rows))
    assert out["line_id"].tolist() == [1, 3] and out["distance"].tolist()[1] == 1.0
    assert list(processor.advance((5,), rows.iloc[1:2])) == []


def test_all_groups_are_closed(arriving, batch):
    stream, late = arriving
    schema = "key long, window_start long, window_end long, alert_count long, max_score double, mean_score double"
    out = waiting(stream(), late, st.AnchoredGroups(4.0, 900, wait=True), schema)
    whole = alerts.group_summary(alerts.anchored_groups(batch.filter("score > 4.0"), 900, keys=["key"]), keys=["key"])
    columns = ["key", "window_start", "window_end", "alert_count", "max_score"]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def test_failures_meet_alerts_in_time(arriving, batch):
    stream, late = arriving
    found = run_available(joins.failures_with_alerts(stream(), stream(), 8.0, 1800, late), "t")
    same(joins.lead_times(found), leadtime.lead_time(batch, 8.0, "within", keys=["key"], seconds=1800), "dlt")


def test_all_windows_are_closed(arriving, batch):
    stream, late = arriving
    out = run_available(windows.tumbling_alerts(stream(), 5.0, "1 hour", late), "t")
    whole = alerts.window_counts(batch, (F.col("score") > 5.0).cast("int"), "1 hour")
    columns = ["window_start", "alerts", "failures"]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def test_windows(stream, batch):
    out = run_available(windows.tumbling_alerts(stream, 5.0, "1 hour", "10 minutes"), "t").toPandas()
    whole = alerts.window_counts(batch, (F.col("score") > 5.0).cast("int"), "1 hour").toPandas()
    both = out.merge(whole, on="window_start", suffixes=("", "_batch"))
    assert len(both) == len(out) >= 4
    assert (both["alerts"] == both["alerts_batch"]).all() and (both["failures"] == both["failures_batch"]).all()


def test_distinct(stream, batch):
    small = stream.select("ts", F.col("key").alias("text"))
    out = run_available(windows.first_copies(small, ["text"], "30 days"), "t")
    assert sorted(r.text for r in out.collect()) == sorted(r.key for r in batch.select("key").distinct().collect())


def test_each_batch_is_written_once(stream):
    out = run_available(stream, "t", each=lambda b: b.groupBy("key").agg(F.count("*").alias("n")))
    assert out.agg(F.sum("n")).first()[0] == 240
