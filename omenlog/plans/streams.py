"""Streams over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.functions import scoring
from omenlog.functions.normalise import normalise
from omenlog.operators import surprise
from omenlog.plans.inputs import EV, LN, THR, events, normal_p99, vectors
from omenlog.plans.registry import query
from omenlog.plans.surprise import ADAPTIVE, LINE_SQL, labelled_lines, model_sql
from omenlog.plans.vectors import XS, cosine_sql
from omenlog.schema import split_lines
from omenlog.session import checkpointed, passing
from omenlog.streaming import joins, windows
from omenlog.streaming import stateful as st
from omenlog.streaming.run import file_stream, files_of, run_available, staged

HOUR = 3_600_000_000


def arriving_events(spark, folder, reach=0):
    """Reads the events as a stream of files, one of them late; and how late rows may be."""
    df = events(spark, folder).drop("kind")
    files = files_of(df)
    path, late = staged(df, reach=reach, files=files)
    return lambda: file_stream(spark, path, path, files_per_batch=files), late


def in_order(stream, late, *columns):
    """The columns of all rows but the closing one, which has moved the watermark by then."""
    rows = stream.withWatermark("ts", late).filter(windows.timely(F.col("line_id").isNotNull()))
    return rows.select("key", "line_id", "ts", "us", *columns)


@query(
    "stream_tumbling_alerts",
    f"""WITH {EV}, {THR}
SELECT us - us % {HOUR} AS window_start, sum(CASE WHEN score > t THEN 1 ELSE 0 END) AS alerts, sum(label) AS failures FROM ev, thr GROUP BY 1""",
    ints=("alerts", "failures"),
)
def stream_tumbling_alerts(spark, folder):
    t = normal_p99(events(spark, folder))
    stream, late = arriving_events(spark, folder, 3600)
    return run_available(windows.tumbling_alerts(stream(), t, "1 hour", late), "tumbling")


@query(
    "stream_sliding_alerts",
    f"""WITH {EV}, {THR}, a AS (SELECT * FROM ev, thr WHERE score > t), w AS (SELECT score, us - us % {HOUR // 2} - i * {HOUR // 2} AS window_start FROM a, (VALUES (0), (1)) AS v(i))
SELECT window_start, count(*) AS alert_count, max(score) AS max_score FROM w GROUP BY 1""",
    digits={"max_score": 4},
)
def stream_sliding_alerts(spark, folder):
    t = normal_p99(events(spark, folder))
    stream, late = arriving_events(spark, folder, 3600)
    return run_available(windows.sliding_alerts(stream(), t, "1 hour", "30 minutes", late), "sliding")


@query(
    "stream_alert_sessions",
    f"""WITH {EV}, {THR}, a AS (SELECT *, us - lag(us) OVER (PARTITION BY key ORDER BY us, line_id) AS gap FROM ev, thr WHERE score > t),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us, line_id) AS s FROM a)
SELECT key, min(us) AS session_start, count(*) AS alert_count, max(score) AS max_score FROM s GROUP BY key, s.s""",
    digits={"max_score": 4},
)
def stream_alert_sessions(spark, folder):
    t = normal_p99(events(spark, folder))
    stream, late = arriving_events(spark, folder, 3600)
    return run_available(windows.alert_sessions(stream(), t, "1 hour", late, ["key"]), "sessions")


@query(
    "stream_delta_ms",
    f"WITH {EV} SELECT key, line_id, greatest(coalesce((us - lag(us) OVER (PARTITION BY key ORDER BY us, line_id)) / 1000, 0), 0) AS delta_ms FROM ev",
    digits={"delta_ms": 3},
)
def stream_delta_ms(spark, folder):
    stream, late = arriving_events(spark, folder)
    out = st.bucketed(in_order(stream(), late), st.DeltaMs(wait=True), "key long, line_id long, delta_ms double")
    return run_available(out, "delta")


@query(
    "stream_hybrid",
    f"""WITH {EV}, r AS (SELECT *, min(score) OVER w AS l1, max(score) OVER w AS h1, min(dist) OVER w AS l2, max(dist) OVER w AS h2 FROM ev
  WINDOW w AS (PARTITION BY key ORDER BY us, line_id ROWS UNBOUNDED PRECEDING))
SELECT key, line_id, 0.5 * (CASE WHEN h1 - l1 < 1e-8 THEN 0 ELSE (score - l1) / (h1 - l1) END) + 0.5 * (CASE WHEN h2 - l2 < 1e-8 THEN 0 ELSE (dist - l2) / (h2 - l2) END) AS hybrid FROM r""",
    digits={"hybrid": 6},
)
def stream_hybrid(spark, folder):
    stream, late = arriving_events(spark, folder)
    rows = in_order(stream(), late, "score", "dist")
    out = st.bucketed(rows, st.Hybrid(wait=True), "key long, line_id long, hybrid double")
    return run_available(out, "hybrid")


@query(
    "stream_lead_time",
    f"""WITH {EV}, {THR}, al AS (SELECT *, min(CASE WHEN score > t THEN us END) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS a FROM ev, thr)
SELECT key, line_id, CASE WHEN a IS NULL THEN 0 ELSE (us - a) / 1e6 END AS dlt FROM al WHERE label = 1""",
    digits={"dlt": 6},
)
def stream_lead_time(spark, folder):
    t = normal_p99(events(spark, folder))
    stream, late = arriving_events(spark, folder, 86400)
    found = run_available(joins.failures_with_alerts(stream(), stream(), t, 86400, late), "lead")
    return joins.lead_times(found).select("key", "line_id", "dlt")


@query(
    "stream_anchored_groups",
    f"""WITH RECURSIVE {EV}, {THR}, a AS (SELECT key, us, score FROM ev, thr WHERE score > t),
g AS (SELECT key, min(us) AS start FROM a GROUP BY key
  UNION ALL
  SELECT key, nxt AS start FROM (SELECT g.key, (SELECT min(a.us) FROM a WHERE a.key = g.key AND a.us > g.start + 86400000000) AS nxt FROM g) WHERE nxt IS NOT NULL)
SELECT g.key, g.start AS window_start, max(a.us) AS window_end, count(*) AS alert_count, max(a.score) AS max_score, avg(a.score) AS mean_score
FROM g JOIN a ON a.key = g.key AND a.us BETWEEN g.start AND g.start + 86400000000 GROUP BY g.key, g.start""",
    digits={"max_score": 4, "mean_score": 6},
)
def stream_anchored_groups(spark, folder):
    t = normal_p99(events(spark, folder))
    stream, late = arriving_events(spark, folder, 86400)
    schema = "key long, window_start long, window_end long, alert_count long, max_score double, mean_score double"
    groups = st.AnchoredGroups(t, 86400, wait=True)
    return run_available(st.bucketed(in_order(stream(), late, "score"), groups, schema), "groups")


def session_knn_sql(capacity: int, k: int) -> str:
    """kNN distance to the last rows of the same label; -1 until there are enough."""
    return f"""WITH o AS (SELECT label AS key, vec_id AS line_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT a.line_id, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.line_id ORDER BY list_distance(a.e, b.e)) AS rk
  FROM o a JOIN o b ON a.key = b.key AND b.i BETWEEN a.i - {capacity} AND a.i - 1),
n AS (SELECT line_id, avg(dist) AS distance FROM r WHERE rk <= {k} GROUP BY line_id HAVING count(*) = {k})
SELECT key, line_id, coalesce(distance, -1) AS distance FROM o LEFT JOIN n USING (line_id)"""


@query("stream_memory_distance", session_knn_sql(32, 5), digits={"distance": 6}, ints=("key",))
def stream_memory_distance(spark, folder):
    raw = file_stream(spark, f"{folder}/embeddings.parquet", f"{folder}/embeddings.parquet")
    stream = raw.select(
        F.col("label").alias("key"), F.col("vec_id").alias("line_id"), F.col("vec_id").alias("us"),
        F.col("embedding").alias("vec"),
    )
    out = run_available(st.stateful(stream, st.Memory(32, 5), "key int, line_id long, distance double"), "memory")
    return out.withColumn("distance", F.coalesce(F.nanvl("distance", F.lit(None)), F.lit(-1.0)))  # -1: not ready


@query("stream_memory_with_idle_reset", session_knn_sql(32, 5), digits={"distance": 6}, ints=("key",))
def stream_memory_with_idle_reset(spark, folder):
    raw = file_stream(spark, f"{folder}/embeddings.parquet", f"{folder}/embeddings.parquet")
    stream = raw.select(
        F.col("label").alias("key"), F.col("vec_id").alias("line_id"), F.col("vec_id").alias("us"),
        F.col("embedding").alias("vec"),
    )
    processor = st.Memory(32, 5, idle_ms=3_600_000)
    out = st.stateful(stream, processor, "key int, line_id long, distance double", time_mode="ProcessingTime")
    out = run_available(out, "memory-idle", one_batch=True)
    return out.withColumn("distance", F.coalesce(F.nanvl("distance", F.lit(None)), F.lit(-1.0)))  # -1: not ready


def session_memory(spark, folder, metric, capacity):
    """``SessionMemory`` per label over vectors that arrive in several files, one of them late; a vector's number is its second."""
    us = F.lit(1_704_067_200_000_000) + F.col("line_id") * 1_000_000
    timed = vectors(spark, folder).select("line_id", F.col("label").cast("int").alias("key"), "vec").withColumn("us", us)
    path, late = staged(timed.withColumn("ts", F.timestamp_micros("us")))
    rows = in_order(file_stream(spark, path, path, files_per_batch=1), late, F.col("vec").cast("array<double>").alias("vec"))
    processor = st.SessionMemory(metric, capacity, wait=True)
    schema = f"key int, line_id long, {st.SESSION_MEMORY[metric]}"
    return run_available(st.stateful(rows, processor, schema, time_mode="EventTime"), f"memory-{metric}")


@query("stream_memory_cosine", cosine_sql("label,", "label AS key,", "label,"), digits={"distance": 6}, ints=("key",))
def stream_memory_cosine(spark, folder):
    out = session_memory(spark, folder, "cosine", 128)
    return out.withColumn("distance", F.coalesce(F.nanvl("distance", F.lit(None)), F.lit(-1.0)))  # -1: not ready


@query("stream_memory_mahalanobis")
def stream_memory_mahalanobis(spark, folder):
    out = session_memory(spark, folder, "mahalanobis", 32)
    return out.withColumn("distance", F.nanvl("distance", F.lit(None)))


@query(
    "stream_memory_statistics",
    f"""WITH {XS}, w AS (SELECT line_id, label, d, avg(v) OVER f AS m, count(*) OVER f AS n, var_samp(v) OVER f AS s FROM x
  WINDOW f AS (PARTITION BY label, d ORDER BY line_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))
SELECT label AS key, line_id, max(n) AS n, coalesce(sum(m), 0) AS sum_mean, coalesce(sum(s), 0) AS total_variance FROM w GROUP BY label, line_id""",
    digits={"sum_mean": 6, "total_variance": 6}, ints=("key", "n"),
)
def stream_memory_statistics(spark, folder):
    zero = F.lit(0.0)
    return session_memory(spark, folder, "statistics", 64).select(
        "key", "line_id", "n", F.coalesce(scoring.array_sum(F.col("mean")), zero).alias("sum_mean"),
        F.coalesce(F.nanvl("total_variance", F.lit(None)), zero).alias("total_variance"),
    )


def document_stream(spark, folder):
    raw = file_stream(spark, f"{folder}/documents.parquet", f"{folder}/documents.parquet")
    lines = split_lines(raw, "doc_id", "text", "source")
    # documents carry no time of their own: their number counts as seconds of a day in 2024
    return lines.withColumn("ts", F.timestamp_seconds(F.col("owner") + 1_704_067_200))


@query(
    "stream_distinct_lines",
    f"WITH {LN} SELECT raw FROM ln GROUP BY raw",
)
def stream_distinct_lines(spark, folder):
    stream = windows.first_copies(document_stream(spark, folder).select("ts", "raw"), ["raw"], "400 days")
    return run_available(stream.select("raw"), "distinct")


@query(
    "stream_line_scores",
    f"{model_sql()}, {LINE_SQL} SELECT line_id, {', '.join(ADAPTIVE)} FROM lb JOIN ls USING (norm)",
    digits={c: 6 for c in ADAPTIVE},
)
def stream_line_scores(spark, folder):
    def score(batch):
        spark = batch.sparkSession
        with passing(spark) as step:
            with passing(spark) as texts:
                with passing(spark) as raw:
                    batch = raw(batch)  # read by the model and by the join: normalised once
                    lines = surprise.numbered_lines(batch, write=texts)
                    every = step(surprise.to_lines(batch.select("line_id", "norm"), lines).drop("norm"))
                scores = surprise.adaptive_scores(surprise.line_signals(model, lines, write=step), ["line_no"])
            return checkpointed(every.join(scores, "line_no").drop("line_no"))

    stream = document_stream(spark, folder).select("line_id", normalise(F.col("raw")).alias("norm"))
    with passing(spark) as kept:
        with passing(spark) as step:
            model = surprise.train(labelled_lines(spark, folder, step).filter("label = 0"), write=kept)
        return run_available(stream.filter("norm <> ''"), "line-scores", each=score)
