"""Time deltas, features and the temporal profile of the events."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from omenlog.functions import time as tf
from omenlog.operators import temporal
from omenlog.operators.order import Order
from omenlog.plans.inputs import EV, ORD, events, orders
from omenlog.plans.registry import query


@query(
    "delta_ms_known",
    f"""WITH {ORD}, g AS (SELECT line_id, CASE WHEN score > 400000 THEN NULL ELSE us END AS us FROM ord),
p AS (SELECT line_id, us, last_value(us IGNORE NULLS) OVER (ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g)
SELECT line_id, greatest(coalesce((us - prev) / 1000, 0), 0) AS delta_ms, ln(1 + greatest(coalesce((us - prev) / 1000, 0), 0)) AS log_delta FROM p""",
    digits={"delta_ms": 3, "log_delta": 6},
)
def delta_ms_known(spark, folder):
    # Orders arrive by id with disordered dates; those of the dearest are taken as unknown.
    df = orders(spark, folder).withColumn("us", F.when(F.col("score") <= 400000, F.col("us")))
    out = temporal.delta_ms(df)
    return out.select("line_id", "delta_ms", tf.log_delta(F.col("delta_ms")).alias("log_delta"))


@query(
    "delta_ms_by_user",
    f"""WITH {EV} SELECT key, line_id, coalesce((us - lag(us) OVER (PARTITION BY key ORDER BY line_id)) / 1000, 0) AS delta_ms FROM ev""",
    digits={"delta_ms": 3},
)
def delta_ms_by_user(spark, folder):
    return temporal.delta_ms(events(spark, folder), keys=["key"]).select("key", "line_id", "delta_ms")


FEATURES = """f AS (SELECT key, line_id, us, coalesce((us - lag(us) OVER ({part} ORDER BY us, line_id)) / 1e6, 0) AS delta_t,
  hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  count(*) OVER ({part} ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND 1 PRECEDING) AS rate_5min,
  count(*) OVER ({part} ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS rate_1hour,
  (us - min(us) OVER ({part})) / 1e6 AS time_since_start FROM ev)"""
FEATURE_COLUMNS = ("line_id", "delta_t", "hour_of_day", "day_of_week", "is_weekend", "rate_5min", "rate_1hour", "time_since_start")
FEATURE_INTS = ("hour_of_day", "day_of_week", "is_weekend")


@query(
    "time_features", f"WITH {EV}, {FEATURES.format(part='')} SELECT {', '.join(FEATURE_COLUMNS)} FROM f",
    digits={"delta_t": 6, "time_since_start": 6}, ints=FEATURE_INTS,
)
def time_features(spark, folder):
    return temporal.features(events(spark, folder)).select(*FEATURE_COLUMNS)


@query(
    "time_features_by_user",
    f"WITH {EV}, {FEATURES.format(part='PARTITION BY key')} SELECT key, {', '.join(FEATURE_COLUMNS)} FROM f",
    digits={"delta_t": 6, "time_since_start": 6}, ints=FEATURE_INTS,
)
def time_features_by_user(spark, folder):
    return temporal.features(events(spark, folder), keys=["key"]).select("key", *FEATURE_COLUMNS)


@query(
    "event_rates_tied_orders",
    f"""WITH {ORD} SELECT line_id, count(*) OVER (ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS day,
  count(*) OVER (ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS week FROM ord""",
)
def event_rates_tied_orders(spark, folder):
    return temporal.event_rates(orders(spark, folder), {"day": 86400, "week": 604800})


@query(
    "features_minmax",
    f"""WITH {EV}, {FEATURES.format(part='')} SELECT line_id, (delta_t - min(delta_t) OVER ()) / (max(delta_t) OVER () - min(delta_t) OVER ()) AS delta_t,
  (rate_1hour - min(rate_1hour) OVER ()) / (max(rate_1hour) OVER () - min(rate_1hour) OVER ()) AS rate_1hour FROM f""",
    digits={"delta_t": 6, "rate_1hour": 6},
)
def features_minmax(spark, folder):
    out, _ = temporal.normalise(temporal.features(events(spark, folder)), ["delta_t", "rate_1hour"])
    return out.select("line_id", "delta_t", "rate_1hour")


@query(
    "features_zscore",
    f"""WITH {EV}, {FEATURES.format(part='')} SELECT line_id, (delta_t - avg(delta_t) OVER ()) / stddev_pop(delta_t) OVER () AS delta_t,
  (rate_1hour - avg(rate_1hour) OVER ()) / stddev_pop(rate_1hour) OVER () AS rate_1hour FROM f""",
    digits={"delta_t": 5, "rate_1hour": 5},
)
def features_zscore(spark, folder):
    out, _ = temporal.normalise(temporal.features(events(spark, folder)), ["delta_t", "rate_1hour"], "zscore")
    return out.select("line_id", "delta_t", "rate_1hour")


@query(
    "feature_scaling_statistics",
    f"""WITH {EV}, {FEATURES.format(part='')} SELECT 'delta_t' AS feature, 'minmax' AS method, min(delta_t) AS first, max(delta_t) AS second FROM f
UNION ALL SELECT 'rate_1hour', 'minmax', min(rate_1hour), max(rate_1hour) FROM f
UNION ALL SELECT 'delta_t', 'zscore', avg(delta_t), stddev_pop(delta_t) FROM f
UNION ALL SELECT 'rate_1hour', 'zscore', avg(rate_1hour), stddev_pop(rate_1hour) FROM f""",
    digits={"first": 4, "second": 4},
)
def feature_scaling_statistics(spark, folder):
    df = temporal.features(events(spark, folder))
    return temporal.normalise(df, ["delta_t", "rate_1hour"])[1].unionByName(
        temporal.normalise(df, ["delta_t", "rate_1hour"], "zscore")[1]
    )


@query(
    "features_log",
    f"WITH {EV}, {FEATURES.format(part='')} SELECT line_id, ln(1 + delta_t) AS delta_t, ln(1 + rate_1hour) AS rate_1hour FROM f",
    digits={"delta_t": 6, "rate_1hour": 6},
)
def features_log(spark, folder):
    out, _ = temporal.normalise(temporal.features(events(spark, folder)), ["delta_t", "rate_1hour"], "log")
    return out.select("line_id", "delta_t", "rate_1hour")


@query(
    "cyclic_features",
    f"""WITH {EV} SELECT line_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos FROM ev""",
    digits={c: 6 for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")},
)
def cyclic_features(spark, folder):
    df = events(spark, folder)
    return df.select(
        "line_id",
        *[c.alias(n) for n, c in {
            **tf.cyclic(F.hour("ts"), 24, "hour"), **tf.cyclic(F.weekday("ts"), 7, "day")
        }.items()],
    )


WAVES = tuple((2 * math.pi / p, 0.1 * i) for i, p in enumerate((60.0, 3600.0, 86400.0)))


@query(
    "periodic_time_components",
    f"""WITH {EV}, g AS (SELECT line_id, ln(1 + coalesce((us - lag(us) OVER (ORDER BY us, line_id)) / 1000, 0)) AS x FROM ev)
SELECT line_id, 0.5 * x + 0.25 AS linear, """ + ", ".join(f"sin({w!r} * x + {p!r}) AS wave{i}" for i, (w, p) in enumerate(WAVES)) + " FROM g",
    digits={"linear": 6, "wave0": 6, "wave1": 6, "wave2": 6},
)
def periodic_time_components(spark, folder):
    df = temporal.gap_seconds(events(spark, folder))
    x = tf.log_delta(F.coalesce(F.col("delta_t"), F.lit(0.0)) * 1000)
    out = df.select("line_id", tf.periodic(x, (0.5, 0.25), WAVES).alias("v"))
    return out.select("line_id", F.col("v")[0].alias("linear"), *[F.col("v")[i + 1].alias(f"wave{i}") for i in range(3)])


@query(
    "weighted_feature_vector",
    f"""WITH {EV}, {FEATURES.format(part='')} SELECT line_id, delta_t * 1.0 AS v0, rate_5min * 0.5 AS v1, rate_1hour * 0.25 AS v2, is_weekend * 2.0 AS v3 FROM f""",
    digits={"v0": 6, "v1": 6, "v2": 6, "v3": 6},
)
def weighted_feature_vector(spark, folder):
    df = temporal.features(events(spark, folder))
    names = ("delta_t", "rate_5min", "rate_1hour", "is_weekend")
    weights = {"rate_5min": 0.5, "rate_1hour": 0.25, "is_weekend": 2.0}
    out = df.select("line_id", tf.feature_vector({n: F.col(n) for n in names}, weights).alias("v"))
    return out.select("line_id", *[F.col("v")[i].alias(f"v{i}") for i in range(4)])


PROFILE_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


@query(
    "temporal_profile",
    f"""WITH {EV}, g AS (SELECT (us - lag(us) OVER (ORDER BY us, line_id)) / 1e6 AS d FROM ev),
h AS (SELECT hour(ts) AS h, count(*) AS n, sum(label) AS bad FROM ev GROUP BY 1)
SELECT count(*) AS total_events, (max(us) - min(us)) / 3.6e9 AS span_hours, count(*) / ((max(us) - min(us)) / 3.6e9) AS events_per_hour,
  sum(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END) AS weekend_events, avg(CASE WHEN isodow(ts) >= 6 THEN 100.0 ELSE 0 END) AS weekend_pct,
  {', '.join(f'sum(CASE WHEN isodow(ts) = {i + 1} THEN 1 ELSE 0 END) AS {d}' for i, d in enumerate(PROFILE_DAYS))},
  sum(label) AS anomalies, avg(label) * 100 AS anomaly_rate,
  sum(CASE WHEN isodow(ts) >= 6 THEN label ELSE 0 END) / sum(label) * 100 AS anomaly_weekend_pct,
  (SELECT h FROM h ORDER BY n DESC, h LIMIT 1) AS peak_hour, (SELECT max(n) FROM h) AS peak_count,
  (SELECT h FROM h ORDER BY n, h LIMIT 1) AS quiet_hour, (SELECT min(n) FROM h) AS quiet_count,
  (SELECT h FROM h ORDER BY bad DESC, h LIMIT 1) AS peak_anomaly_hour,
  (SELECT avg(d) FROM g) AS gap_mean, (SELECT stddev_pop(d) FROM g) AS gap_std, (SELECT min(d) FROM g) AS gap_min, (SELECT max(d) FROM g) AS gap_max,
  (SELECT median(d) FROM g) AS gap_median, (SELECT quantile_cont(d, 0.95) FROM g) AS gap_p95, (SELECT quantile_cont(d, 0.99) FROM g) AS gap_p99
FROM ev""",
    digits={"span_hours": 4, "events_per_hour": 4, "weekend_pct": 4, "anomaly_rate": 4, "anomaly_weekend_pct": 4, "gap_mean": 3, "gap_std": 3,
            "gap_min": 6, "gap_max": 6, "gap_median": 3, "gap_p95": 3, "gap_p99": 3},
    ints=("weekend_events", *PROFILE_DAYS, "anomalies", "peak_hour", "quiet_hour", "peak_anomaly_hour"),
)
def temporal_profile(spark, folder):
    return temporal.profile(events(spark, folder))


@query(
    "roll_up_by_time",
    f"""WITH {EV}, m AS (SELECT us - us % 60000000 AS w, avg(score) AS m FROM ev GROUP BY 1)
SELECT w - w % 3600000000 AS hour_start, avg(m) AS hour_mean, count(*) AS minutes FROM m GROUP BY 1""",
    digits={"hour_mean": 9},
)
def roll_up_by_time(spark, folder):
    return temporal.roll_up(events(spark, folder))


@query(
    "roll_up_by_rows",
    f"""WITH {EV}, o AS (SELECT score, row_number() OVER (ORDER BY us, line_id) - 1 AS pos FROM ev)
SELECT pos // 60 AS step, avg(score) AS mean FROM o GROUP BY 1 HAVING count(*) = 60""",
    digits={"mean": 9},
)
def roll_up_by_rows(spark, folder):
    return temporal.roll_up_rows(events(spark, folder), 60, order=Order())


def raw_lines(spark, folder):
    """Events written as raw lines of the three dialects (errors carry a tag)."""
    df = events(spark, folder)
    epoch = F.floor(F.col("us") / 1_000_000)
    tag = F.when(F.col("label") == 1, F.col("kind")).otherwise("-")
    return df.select(
        "line_id",
        F.format_string("%s %d 2005.06.03 R02-M1 RAS KERNEL %s", tag, epoch, "kind").alias("bgl"),
        F.format_string("%s %d 0 master.HPC %s", tag, epoch, "kind").alias("thunderbird"),
        F.concat(
            # signups log an impossible month
            F.when(F.col("kind") == "signup", "089913 000000").otherwise(F.date_format("ts", "yyMMdd HHmmss")),
            F.lit(" 148 INFO "), F.col("kind"),
        ).alias("hdfs"),
    )


@query(
    "extracted_event_times",
    f"""WITH {EV} SELECT line_id, us // 1000000 AS bgl, CASE WHEN label = 0 THEN us // 1000000 ELSE -1 END AS thunderbird,
  us // 1000000 AS thunderbird_any_tag, CASE WHEN kind = 'signup' THEN -1 ELSE us // 1000000 END AS hdfs FROM ev""",
)
def extracted_event_times(spark, folder):
    def seconds(c):
        return F.coalesce(F.unix_seconds(c), F.lit(-1))

    return raw_lines(spark, folder).select(
        "line_id",
        seconds(tf.event_time(F.col("bgl"), "bgl")).alias("bgl"),
        seconds(tf.event_time(F.col("thunderbird"), "thunderbird")).alias("thunderbird"),
        seconds(tf.event_time(F.col("thunderbird"), "thunderbird", any_tag=True)).alias("thunderbird_any_tag"),
        seconds(tf.event_time(F.col("hdfs"), "hdfs")).alias("hdfs"),
    )
