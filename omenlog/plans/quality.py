"""Timestamp audit of the events and of the (disordered) orders."""

from __future__ import annotations

from omenlog.operators import quality
from omenlog.plans.inputs import EV, ORD, events, orders
from omenlog.plans.registry import query

GAPS = "gp AS (SELECT line_id, us, lag(line_id) OVER (ORDER BY line_id) AS prev_line, (us - lag(us) OVER (ORDER BY line_id)) / 1e6 AS gap FROM {t})"


@query(
    "order_violations",
    f"""WITH {ORD}, {GAPS.format(t='ord')} SELECT sum(CASE WHEN gap < 0 THEN 1 ELSE 0 END) AS violations,
  min(CASE WHEN gap < 0 THEN prev_line END) AS first_violation, CASE WHEN count(CASE WHEN gap < 0 THEN 1 END) = 0 THEN 1 ELSE 0 END AS is_monotonic FROM gp""",
    ints=("violations", "is_monotonic"), nulls={"first_violation": -1},
)
def order_violations(spark, folder):
    return quality.monotonicity(orders(spark, folder))


def gap_sql(source: str, name: str) -> str:
    return f"""WITH {source}, {GAPS.format(t=name)}, m AS (SELECT median(gap) AS typical FROM gp WHERE gap > 0)
SELECT count(gap) AS gaps, avg(gap) AS mean, stddev_pop(gap) AS std, min(gap) AS min, max(gap) AS max,
  count(CASE WHEN gap = 0 THEN 1 END) AS zero_gaps, count(CASE WHEN gap > typical * 100 THEN 1 END) AS extreme_gaps,
  count(CASE WHEN gap < 0 THEN 1 END) AS negative_gaps, median(gap) AS median, quantile_cont(gap, 0.95) AS p95, quantile_cont(gap, 0.99) AS p99,
  count(CASE WHEN gap = 0 THEN 1 END) / count(gap) * 100 AS zero_gap_pct FROM gp, m"""


GAP_DIGITS = {c: 3 for c in ("mean", "std", "min", "max", "median", "p95", "p99", "zero_gap_pct")}


@query("gap_audit_events", gap_sql(EV, "ev"), digits=GAP_DIGITS)
def gap_audit_events(spark, folder):
    return quality.gap_audit(events(spark, folder))


@query("gap_audit_orders", gap_sql(ORD, "ord"), digits=GAP_DIGITS)
def gap_audit_orders(spark, folder):
    return quality.gap_audit(orders(spark, folder))


@query(
    "duplicate_timestamps",
    f"""WITH {ORD} SELECT count(*) - count(DISTINCT us) AS num_duplicates, (count(*) - count(DISTINCT us)) / count(*) * 100 AS duplicate_pct,
  count(DISTINCT us) AS unique_timestamps FROM ord""",
    digits={"duplicate_pct": 6}, ints=("num_duplicates",),
)
def duplicate_timestamps(spark, folder):
    return quality.duplicates(orders(spark, folder))


@query(
    "timestamp_coverage",
    f"""WITH {EV} SELECT min(us) AS start_us, max(us) AS end_us, count(*) AS total_events, (max(us) - min(us)) / 3.6e9 AS span_hours,
  count(*) / ((max(us) - min(us)) / 1e6) AS per_second, count(*) / ((max(us) - min(us)) / 1e6) * 60 AS per_minute,
  count(*) / ((max(us) - min(us)) / 1e6) * 3600 AS per_hour FROM ev""",
    digits={"span_hours": 5, "per_second": 6, "per_minute": 5, "per_hour": 4},
)
def timestamp_coverage(spark, folder):
    return quality.coverage(events(spark, folder))


def slot_sql(name: str, slot: str) -> str:
    return f"""{name}_t AS (SELECT {slot} AS s, count(*) AS n FROM ev GROUP BY 1), {name}_r AS (SELECT coalesce(stddev_samp(n) / avg(n), 0) AS {name}_cv,
  (SELECT s FROM {name}_t ORDER BY n DESC, s LIMIT 1) AS {name}_peak, (SELECT s FROM {name}_t ORDER BY n, s LIMIT 1) AS {name}_quiet,
  max(n) AS {name}_peak_count, min(n) AS {name}_quiet_count FROM {name}_t)"""


@query(
    "event_frequency",
    f"WITH {EV}, {slot_sql('hour', 'hour(ts)')}, {slot_sql('day', 'isodow(ts) - 1')} SELECT * FROM hour_r CROSS JOIN day_r",
    digits={"hour_cv": 6, "day_cv": 6}, ints=("hour_peak", "hour_quiet", "day_peak", "day_quiet"),
)
def event_frequency(spark, folder):
    return quality.frequency(events(spark, folder))


@query(
    "gap_outliers",
    f"""WITH {EV}, {GAPS.format(t='ev')}, q AS (SELECT quantile_cont(gap, 0.25) AS q1, quantile_cont(gap, 0.75) AS q3 FROM gp),
b AS (SELECT q3 - q1 AS iqr, q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper FROM q)
SELECT count(gap) AS gaps, count(CASE WHEN gap < lower THEN 1 END) AS outliers_low, count(CASE WHEN gap > upper THEN 1 END) AS outliers_high,
  count(CASE WHEN gap < lower OR gap > upper THEN 1 END) AS outliers,
  count(CASE WHEN gap < lower OR gap > upper THEN 1 END) / count(gap) * 100 AS outliers_pct,
  any_value(iqr) AS iqr, any_value(lower) AS lower, any_value(upper) AS upper FROM gp, b""",
    digits={"outliers_pct": 6, "iqr": 3, "lower": 3, "upper": 3},
)
def gap_outliers(spark, folder):
    return quality.gap_outliers(events(spark, folder))


@query(
    "failure_timestamps",
    f"""WITH {EV}, g AS (SELECT (us - lag(us) OVER (ORDER BY line_id)) / 1e6 AS gap FROM ev WHERE label = 1)
SELECT count(*) AS num_failures, avg(gap) AS mean, min(gap) AS min, max(gap) AS max, median(gap) AS median,
  count(*) / (SELECT count(*) FROM ev) AS failure_rate FROM g""",
    digits={"mean": 3, "min": 6, "max": 6, "median": 3, "failure_rate": 6},
)
def failure_timestamps(spark, folder):
    return quality.failure_audit(events(spark, folder))


@query(
    "failure_calendar",
    f"""WITH {EV} SELECT 'hour' AS unit, hour(ts) AS slot, count(*) AS failures FROM ev WHERE label = 1 GROUP BY 2
UNION ALL SELECT 'weekday', isodow(ts) - 1, count(*) FROM ev WHERE label = 1 GROUP BY 2""",
    ints=("slot",),
)
def failure_calendar(spark, folder):
    return quality.failure_calendar(events(spark, folder))


def issues_sql(source: str, name: str) -> str:
    return f"""WITH {source}, {GAPS.format(t=name)}, fg AS (SELECT us - lag(us) OVER (ORDER BY line_id) AS g FROM {name} WHERE label = 1),
q AS (SELECT quantile_cont(gap, 0.25) AS q1, quantile_cont(gap, 0.75) AS q3, median(CASE WHEN gap > 0 THEN gap END) AS typical FROM gp),
m AS (SELECT count(CASE WHEN gap < 0 THEN 1 END) AS neg, count(CASE WHEN gap = 0 THEN 1 END) / count(gap) * 100 AS zero,
      count(CASE WHEN gap > typical * 100 THEN 1 END) AS extreme,
      count(CASE WHEN gap < q1 - 3 * (q3 - q1) OR gap > q3 + 3 * (q3 - q1) THEN 1 END) / count(gap) * 100 AS outl FROM gp, q),
d AS (SELECT (count(*) - count(DISTINCT us)) / count(*) * 100 AS dup, (max(us) - min(us)) / 3.6e9 AS span FROM {name}),
f AS (SELECT min(g) / 1e6 AS fgap FROM fg),
i AS (SELECT 'critical' AS severity, 'non_monotonic' AS type, neg AS measure, neg > 0 AS hit FROM m
UNION ALL SELECT 'warning', 'excessive_zero_gaps', zero, zero > 10 FROM m
UNION ALL SELECT 'warning', 'extreme_gaps', extreme, extreme > 0 FROM m
UNION ALL SELECT 'critical', 'negative_gaps', neg, neg > 0 FROM m
UNION ALL SELECT 'warning', 'high_duplicate_rate', dup, dup > 5 FROM d
UNION ALL SELECT 'warning', 'short_time_span', span, span < 60.0 / 3600 FROM d
UNION ALL SELECT 'warning', 'high_outlier_rate', outl, outl > 5 FROM m
UNION ALL SELECT 'warning', 'failures_too_close', fgap, fgap < 1 FROM f)"""


VERDICT = """ SELECT count(CASE WHEN severity = 'critical' THEN 1 END) AS critical, count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings,
  CASE WHEN count(CASE WHEN severity = 'critical' THEN 1 END) > 0 THEN 'FAILED' WHEN count(*) > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM i WHERE hit"""


@query("timestamp_issues", issues_sql(ORD, "ord") + " SELECT severity, type, measure FROM i WHERE hit", digits={"measure": 4})
def timestamp_issues(spark, folder):
    return quality.issues(orders(spark, folder))


@query("timestamp_verdict_orders", issues_sql(ORD, "ord") + VERDICT)
def timestamp_verdict_orders(spark, folder):
    return quality.verdict(quality.issues(orders(spark, folder)))


@query("timestamp_verdict_events", issues_sql(EV, "ev") + VERDICT)
def timestamp_verdict_events(spark, folder):
    return quality.verdict(quality.issues(events(spark, folder)))


@query(
    "timestamp_quick_check",
    f"""WITH {ORD}, {GAPS.format(t='ord')}, z AS (SELECT *, CASE WHEN gap <> 0 THEN gap END AS g FROM gp)
SELECT count(*) AS rows, count(CASE WHEN gap = 0 THEN 1 END) AS same_as_previous, avg(g) AS mean, min(g) AS min, max(g) AS max,
  (max(us) - min(us)) / 1e6 AS range_seconds, quantile_cont(g, 0.25) AS p25, quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.75) AS p75,
  quantile_cont(g, 0.9) AS p90, quantile_cont(g, 0.95) AS p95, quantile_cont(g, 0.99) AS p99 FROM z""",
    digits={c: 2 for c in ("mean", "min", "max", "range_seconds", "p25", "p50", "p75", "p90", "p95", "p99")},
)
def timestamp_quick_check(spark, folder):
    return quality.quick_check(orders(spark, folder))
