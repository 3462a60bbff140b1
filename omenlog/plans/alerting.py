"""Alert groups, alert fatigue and priorities over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.operators import alerts
from omenlog.operators.classify import flag
from omenlog.plans.inputs import EV, THR, events, normal_p99
from omenlog.plans.registry import query


def anchored_sql(width: int, quantile: float, keyed: bool = False) -> str:
    """Group starts by recursion over the alerts: relation ``m`` (alerts with window_start)."""
    part = "PARTITION BY key" if keyed else ""
    key = "a.key = g.key AND" if keyed else ""
    return f"""WITH RECURSIVE {EV}, th AS (SELECT quantile_cont(score, {quantile}) AS t FROM ev),
a AS (SELECT ev.*, row_number() OVER ({part} ORDER BY us, line_id) AS rn FROM ev, th WHERE score > t),
g AS (SELECT key, line_id, rn, us AS window_start FROM a WHERE rn = 1
      UNION ALL
      SELECT a.key, a.line_id, a.rn, CASE WHEN a.us - g.window_start <= {width} THEN g.window_start ELSE a.us END
      FROM g JOIN a ON {key} a.rn = g.rn + 1),
m AS (SELECT a.*, g.window_start FROM a JOIN g USING (line_id))"""


GROUPS = """gr AS (SELECT *, CASE WHEN max_score > 10 AND tp / alert_count > 0.8 THEN 'critical'
    WHEN max_score > 8 OR tp / alert_count > 0.6 THEN 'high' WHEN max_score > 6 OR tp / alert_count > 0.4 THEN 'medium' ELSE 'low' END AS priority
  FROM (SELECT window_start, max(us) AS window_end, count(*) AS alert_count, max(score) AS max_score, avg(score) AS mean_score,
        min(line_id) AS first_line, max(line_id) AS last_line, sum(label) AS tp, sum(1 - label) AS fp FROM m GROUP BY window_start))"""
HOUR, FIVE = 3_600_000_000, 300_000_000


def alerts_over(spark, folder, quantile):
    from omenlog.operators.order import quantile_list

    df = events(spark, folder)
    t = quantile_list(df, F.col("score"), [quantile])[0]
    return df.filter(F.col("score") > t)


@query("anchored_group_members", f"{anchored_sql(HOUR, 0.9)} SELECT line_id, us, window_start FROM m")
def anchored_group_members(spark, folder):
    return alerts.anchored_groups(alerts_over(spark, folder, 0.9), 3600).select("line_id", "us", "window_start")


@query(
    "anchored_group_members_by_user",
    f"{anchored_sql(24 * HOUR, 0.8, keyed=True)} SELECT key, line_id, us, window_start FROM m",
)
def anchored_group_members_by_user(spark, folder):
    found = alerts.anchored_groups(alerts_over(spark, folder, 0.8), 86400, keys=["key"])
    return found.select("key", "line_id", "us", "window_start")


@query(
    "anchored_groups", f"{anchored_sql(HOUR, 0.9)}, {GROUPS} SELECT * FROM gr",
    digits={"max_score": 4, "mean_score": 9}, ints=("tp", "fp"),
)
def anchored_groups(spark, folder):
    return alerts.group_summary(alerts.anchored_groups(alerts_over(spark, folder, 0.9), 3600))


@query(
    "anchored_groups_min_score",
    f"{anchored_sql(FIVE, 0.5).replace('WHERE score > t)', 'WHERE score > t AND score >= 60)')}, {GROUPS} SELECT * FROM gr",
    digits={"max_score": 4, "mean_score": 9}, ints=("tp", "fp"),
)
def anchored_groups_min_score(spark, folder):
    found = alerts.anchored_groups(alerts_over(spark, folder, 0.5), 300, min_score=60.0)
    return alerts.group_summary(found)


@query(
    "group_metrics",
    f"""{anchored_sql(HOUR, 0.9)}, {GROUPS} SELECT sum(alert_count) AS total_alerts, count(*) AS total_groups,
  {', '.join(f"sum(CASE WHEN priority = '{p}' THEN 1 ELSE 0 END) AS {p}" for p in ('critical', 'high', 'medium', 'low'))},
  (1 - count(*) / sum(alert_count)) * 100 AS reduction_pct, sum(alert_count) / count(*) AS avg_per_group FROM gr""",
    digits={"reduction_pct": 6, "avg_per_group": 6}, ints=("total_alerts", "critical", "high", "medium", "low"),
)
def group_metrics(spark, folder):
    found = alerts.anchored_groups(alerts_over(spark, folder, 0.9), 3600)
    return alerts.group_metrics(alerts.group_summary(found))


@query(
    "top_alert_groups",
    f"""{anchored_sql(HOUR, 0.9)}, {GROUPS} SELECT window_start, alert_count, max_score, priority FROM gr
ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, max_score DESC, window_start LIMIT 10""",
    digits={"max_score": 4},
)
def top_alert_groups(spark, folder):
    groups = alerts.group_summary(alerts.anchored_groups(alerts_over(spark, folder, 0.9), 3600))
    return alerts.top_groups(groups, 10).select("window_start", "alert_count", "max_score", "priority")


@query(
    "label_free_priority",
    f"""WITH {EV} SELECT kind, CASE WHEN max(score) > 10 THEN 'critical' WHEN max(score) > 8 THEN 'high'
  WHEN max(score) > 6 THEN 'medium' ELSE 'low' END AS priority, key, count(*) AS n FROM ev GROUP BY kind, key""",
)
def label_free_priority(spark, folder):
    groups = events(spark, folder).groupBy("kind", "key").agg(F.max("score").alias("m"), F.count("*").alias("n"))
    return groups.select("kind", alerts.priority(F.col("m")).alias("priority"), "key", "n")


@query(
    "sliding_alert_volume",
    f"""WITH {EV}, {THR}, a AS (SELECT * FROM ev, thr WHERE score > t),
w AS (SELECT score, label, us - us % {HOUR // 2} - i * {HOUR // 2} AS window_start FROM a, (VALUES (0), (1)) AS v(i))
SELECT window_start, count(*) AS alert_count, max(score) AS max_score, sum(label) AS tp FROM w GROUP BY window_start""",
    digits={"max_score": 4}, ints=("tp",),
)
def sliding_alert_volume(spark, folder):
    df = events(spark, folder)
    return alerts.sliding_volume(df.filter(F.col("score") > normal_p99(df)), "1 hour", "30 minutes")


def precision_sql(name: str, width: int) -> str:
    return f"""SELECT '{name}' AS window_size, count(*) AS total_windows, sum(CASE WHEN alerts > 0 THEN 1 ELSE 0 END) AS alert_windows,
  sum(CASE WHEN failures > 0 THEN 1 ELSE 0 END) AS failure_windows,
  sum(CASE WHEN alerts > 0 AND failures = 0 THEN 1 ELSE 0 END) AS false_alarm_windows,
  coalesce(avg(CASE WHEN alerts > 0 THEN alerts END), 0) AS avg_alerts, coalesce(max(CASE WHEN alerts > 0 THEN alerts END), 0) AS max_alerts,
  sum(CASE WHEN alerts > 0 AND failures > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN alerts > 0 THEN 1 ELSE 0 END) AS precision_in_windows,
  sum(CASE WHEN alerts > 0 AND failures = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN alerts > 0 THEN 1 ELSE 0 END) AS false_alarm_rate
FROM (SELECT us - us % {width} AS w, sum(CASE WHEN score > t THEN 1 ELSE 0 END) AS alerts, sum(label) AS failures FROM ev, thr GROUP BY 1)"""


WINDOWS = (("30 minutes", 1_800_000_000), ("1 hour", HOUR), ("6 hours", 6 * HOUR))
WINDOW_INTS = ("total_windows", "alert_windows", "failure_windows", "false_alarm_windows", "max_alerts")


@query(
    "window_alert_precision",
    f"WITH {EV}, {THR} " + " UNION ALL ".join(precision_sql(n, w) for n, w in WINDOWS),
    digits={"avg_alerts": 6, "precision_in_windows": 6, "false_alarm_rate": 6}, ints=WINDOW_INTS,
)
def window_alert_precision(spark, folder):
    df = events(spark, folder)
    hit = flag(F.col("score"), normal_p99(df))
    return alerts.window_precision(df, hit, *[name for name, _ in WINDOWS])


@query(
    "hourly_alert_windows",
    f"""WITH {EV}, {THR} SELECT us - us % {HOUR} AS window_start, sum(CASE WHEN score > t THEN 1 ELSE 0 END) AS alerts,
  sum(label) AS failures FROM ev, thr GROUP BY 1""",
    ints=("alerts", "failures"),
)
def hourly_alert_windows(spark, folder):
    df = events(spark, folder)
    return alerts.window_counts(df, flag(F.col("score"), normal_p99(df)), "1 hour")


@query(
    "alert_concentration",
    f"""WITH {EV}, {THR}, a AS (SELECT us, line_id, (us - lag(us) OVER (ORDER BY us, line_id)) / 1e6 AS gap FROM ev, thr WHERE score > t)
SELECT count(*) AS total_alerts, stddev_pop(gap) / avg(gap) AS concentration, avg(gap) AS avg_gap, median(gap) AS median_gap,
  min(gap) AS min_gap, max(gap) AS max_gap FROM a""",
    digits={"concentration": 6, "avg_gap": 3, "median_gap": 3, "min_gap": 6, "max_gap": 6},
)
def alert_concentration(spark, folder):
    df = events(spark, folder)
    return alerts.concentration(df, flag(F.col("score"), normal_p99(df)))
