"""Lead times of the failures among the events, their summaries and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.operators import classify, leadtime, sweep
from omenlog.operators.order import quantile_list
from omenlog.plans.detection import CELLS, RATE_DIGITS, grid_sql, table_sql
from omenlog.plans.inputs import EV, ORD, THR, events, normal_p99, orders
from omenlog.plans.registry import query

LAST = """al AS (SELECT *, max(CASE WHEN score >= t THEN us END) OVER ({part} ORDER BY us, line_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alert_us FROM ev CROSS JOIN thr)"""
WITHIN = """al AS (SELECT *, min(CASE WHEN score > t THEN us END) OVER ({part} ORDER BY us
  RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS alert_us FROM ev CROSS JOIN thr)"""
ROWS = """al AS (SELECT *, min(CASE WHEN score > t THEN us END) OVER ({part} ORDER BY us, line_id
  ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS alert_us FROM ev CROSS JOIN thr)"""
DLT = "d AS (SELECT key, line_id, us, alert_us, CASE WHEN alert_us IS NULL THEN 0 ELSE (us - alert_us) / 1e6 END AS dlt FROM al WHERE label = 1)"


def detail_sql(kind: str, part: str = "") -> str:
    return f"WITH {EV}, {THR}, {kind.format(part=part)}, {DLT}"


def lead(spark, folder, mode, **kw):
    df = events(spark, folder)
    return leadtime.lead_time(df, normal_p99(df), mode, **kw)


@query("lead_time_last_alert", detail_sql(LAST) + " SELECT line_id, us, alert_us, dlt FROM d", digits={"dlt": 6}, nulls={"alert_us": -1})
def lead_time_last_alert(spark, folder):
    return lead(spark, folder, "last")


@query("lead_time_last_alert_by_user", detail_sql(LAST, "PARTITION BY key") + " SELECT * FROM d", digits={"dlt": 6}, nulls={"alert_us": -1})
def lead_time_last_alert_by_user(spark, folder):
    return lead(spark, folder, "last", keys=["key"])


@query("lead_time_within_hour", detail_sql(WITHIN) + " SELECT line_id, us, alert_us, dlt FROM d", digits={"dlt": 6}, nulls={"alert_us": -1})
def lead_time_within_hour(spark, folder):
    return lead(spark, folder, "within")


@query("lead_time_within_hour_by_user", detail_sql(WITHIN, "PARTITION BY key") + " SELECT * FROM d", digits={"dlt": 6}, nulls={"alert_us": -1})
def lead_time_within_hour_by_user(spark, folder):
    return lead(spark, folder, "within", keys=["key"])


@query("lead_time_in_rows", detail_sql(ROWS) + " SELECT line_id, us, alert_us, dlt FROM d", digits={"dlt": 6}, nulls={"alert_us": -1})
def lead_time_in_rows(spark, folder):
    return lead(spark, folder, "rows")


@query("lead_time_in_rows_by_user", detail_sql(ROWS, "PARTITION BY key") + " SELECT * FROM d", digits={"dlt": 6}, nulls={"alert_us": -1})
def lead_time_in_rows_by_user(spark, folder):
    return lead(spark, folder, "rows", keys=["key"])


@query(
    "lead_time_tied_orders",
    f"WITH {ORD.replace('ord AS', 'ev AS')}, {THR}, {WITHIN.format(part='').replace('3600000000', '864000000000')}, {DLT} "
    "SELECT line_id, us, alert_us, dlt FROM d",
    digits={"dlt": 6}, nulls={"alert_us": -1},
)
def lead_time_tied_orders(spark, folder):
    df = orders(spark, folder)
    return leadtime.lead_time(df, normal_p99(df), "within", seconds=864000)


def in_rows(spark, folder, mode="rows"):
    return lead(spark, folder, mode)


@query(
    "lead_time_details",
    detail_sql(ROWS) + """ SELECT line_id, us, alert_us, dlt AS dlt, dlt / 60 AS dlt_minutes,
  hour(make_timestamp(us)) AS hour, isodow(make_timestamp(us)) - 1 AS day FROM d""",
    digits={"dlt": 6, "dlt_minutes": 4}, ints=("hour", "day"), nulls={"alert_us": -1},
)
def lead_time_details(spark, folder):
    when = F.timestamp_micros("us")
    return in_rows(spark, folder, "rows_raw").withColumns({
        "dlt_minutes": F.col("dlt") / 60, "hour": F.hour(when), "day": F.weekday(when)
    })


SUMMARY = """SELECT count(*) AS total_failures, avg(dlt) AS mean_dlt, stddev_pop(dlt) AS std_dlt, min(dlt) AS min_dlt,
  max(dlt) AS max_dlt, avg(CASE WHEN dlt > 0 THEN 100.0 ELSE 0 END) AS positive_pct,
  avg(CASE WHEN dlt >= 300 THEN 100.0 ELSE 0 END) AS ewr_5min, avg(CASE WHEN dlt >= 900 THEN 100.0 ELSE 0 END) AS ewr_15min,
  avg(CASE WHEN dlt >= 3600 THEN 100.0 ELSE 0 END) AS ewr_1hour, median(dlt) AS median_dlt FROM d"""
SUMMARY_DIGITS = {
    c: 3 for c in ("mean_dlt", "std_dlt", "min_dlt", "max_dlt", "positive_pct", "ewr_5min", "ewr_15min", "ewr_1hour", "median_dlt")
}


@query("lead_time_summary", f"{detail_sql(ROWS)} {SUMMARY}", digits=SUMMARY_DIGITS)
def lead_time_summary(spark, folder):
    return leadtime.summary(in_rows(spark, folder))


@query("lead_time_summary_within_hour", f"{detail_sql(WITHIN)} {SUMMARY}", digits=SUMMARY_DIGITS)
def lead_time_summary_within_hour(spark, folder):
    return leadtime.summary(lead(spark, folder, "within"))


@query(
    "lead_time_categories",
    f"""{detail_sql(WITHIN)}, b(rank, category, lo, hi) AS (VALUES (0, 'reactive (0s)', -1, 0), (1, '1s-1min', 0, 60), (2, '1-5min', 60, 300),
  (3, '5-15min', 300, 900), (4, '15-60min', 900, 3600), (5, '1-6hour', 3600, 21600), (6, '6hour+', 21600, 1000000000000))
SELECT rank, category, count(dlt) AS failures FROM b LEFT JOIN d ON dlt > lo AND dlt <= hi GROUP BY rank, category""",
    ints=("rank",),
)
def lead_time_categories(spark, folder):
    return leadtime.categories(lead(spark, folder, "within"))


@query(
    "lead_time_percentiles",
    f"""{detail_sql(ROWS)} SELECT p AS percentile, coalesce(
  (SELECT quantile_cont(dlt, 0.5) FROM d WHERE dlt > 0), 0) AS dlt FROM (VALUES (50)) AS v(p)
UNION ALL SELECT 75, (SELECT quantile_cont(dlt, 0.75) FROM d WHERE dlt > 0)
UNION ALL SELECT 90, (SELECT quantile_cont(dlt, 0.9) FROM d WHERE dlt > 0)
UNION ALL SELECT 95, (SELECT quantile_cont(dlt, 0.95) FROM d WHERE dlt > 0)
UNION ALL SELECT 99, (SELECT quantile_cont(dlt, 0.99) FROM d WHERE dlt > 0)""",
    digits={"dlt": 3}, ints=("percentile",),
)
def lead_time_percentiles(spark, folder):
    return leadtime.percentiles(in_rows(spark, folder))


@query(
    "lead_time_by_calendar",
    f"""{detail_sql(ROWS)}, w AS (SELECT dlt, hour(make_timestamp(us)) AS h, isodow(make_timestamp(us)) - 1 AS wd FROM d WHERE alert_us IS NOT NULL)
SELECT 'hour' AS unit, h AS slot, count(*) AS failures, avg(dlt) AS mean_dlt, median(dlt) AS median_dlt FROM w GROUP BY h
UNION ALL SELECT 'weekday', wd, count(*), avg(dlt), median(dlt) FROM w GROUP BY wd""",
    digits={"mean_dlt": 3, "median_dlt": 3}, ints=("slot",),
)
def lead_time_by_calendar(spark, folder):
    return leadtime.by_calendar(in_rows(spark, folder, "rows_raw"))


@query(
    "early_warning_rate",
    f"{detail_sql(LAST)} SELECT coalesce(avg(CASE WHEN dlt >= 300 THEN 100.0 ELSE 0 END), 0) AS ewr FROM d",
    digits={"ewr": 6},
)
def early_warning_rate(spark, folder):
    return lead(spark, folder, "last").agg(leadtime.warning_rate(300).alias("ewr"))


@query(
    "early_warning_horizons",
    f"""{detail_sql(LAST)} SELECT h AS horizon, sum(CASE WHEN dlt >= h THEN 1 ELSE 0 END) AS failures,
  avg(CASE WHEN dlt >= h THEN 100.0 ELSE 0 END) AS percentage
FROM d CROSS JOIN (VALUES (60), (300), (600), (1800), (3600), (21600)) AS v(h) GROUP BY h""",
    digits={"percentage": 6}, ints=("horizon", "failures"),
)
def early_warning_horizons(spark, folder):
    return leadtime.horizons(lead(spark, folder, "last"))


# ------------------------------------------------------------------ sweeps


def per_threshold_sql(grid: str) -> str:
    """Quality and lead times per grid threshold as a relation ``tab``."""
    return f"""WITH {EV}, {grid}, {table_sql('>')},
al AS (SELECT q, line_id, us, label, min(CASE WHEN score > threshold THEN us END)
         OVER (PARTITION BY q ORDER BY us, line_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS alert_us FROM grid, ev),
ld AS (SELECT q, CASE WHEN alert_us IS NULL THEN 0 ELSE (us - alert_us) / 1e6 END AS dlt FROM al WHERE label = 1),
ls AS (SELECT q, avg(CASE WHEN dlt >= 300 THEN 100.0 ELSE 0 END) AS ewr, avg(dlt) AS mean_dlt, median(dlt) AS median_dlt,
         max(dlt) AS max_dlt FROM ld GROUP BY q),
tab AS (SELECT sw.*, ewr, mean_dlt, median_dlt, max_dlt FROM sw JOIN ls USING (q))"""


TABLE_DIGITS = {**RATE_DIGITS, "threshold": 6, "ewr": 6, "mean_dlt": 3, "median_dlt": 3, "max_dlt": 3}
SENSITIVITY = grid_sql("percentile", 10, 99, 20)


def sensitivity_table(spark, folder):
    df = events(spark, folder)
    return leadtime.sensitivity(df, sweep.percentile_thresholds(df, 10, 99, 20))


@query(
    "threshold_sensitivity", f"{per_threshold_sql(SENSITIVITY)} SELECT * FROM tab",
    digits=TABLE_DIGITS, ints=("q", *CELLS),
)
def threshold_sensitivity(spark, folder):
    return sensitivity_table(spark, folder)


@query(
    "pareto_thresholds",
    f"""{per_threshold_sql(SENSITIVITY)} SELECT q, threshold, f1, ewr FROM tab AS a WHERE NOT EXISTS (
  SELECT 1 FROM tab AS b WHERE b.f1 >= a.f1 AND b.ewr >= a.ewr AND (b.f1 > a.f1 OR b.ewr > a.ewr))""",
    digits={"threshold": 6, "f1": 6, "ewr": 6}, ints=("q",),
)
def pareto_thresholds(spark, folder):
    table = sensitivity_table(spark, folder)
    return leadtime.pareto_front(table, ["f1", "ewr"]).select("q", "threshold", "f1", "ewr")


EARLY_COLUMNS = ("ewr", "fpr", "f1", "precision", "recall", "mean_dlt")


@query(
    "best_early_threshold",
    f"""{per_threshold_sql(grid_sql('linear', 0.01, 0, 100))},
best AS (SELECT * FROM tab WHERE fpr <= 0.05 AND ewr > 0 ORDER BY ewr DESC, q LIMIT 1),
lastq AS (SELECT threshold FROM tab ORDER BY q DESC LIMIT 1)
SELECT CASE WHEN (SELECT count(*) FROM best) = 0 THEN 'failed' ELSE 'success' END AS status,
  coalesce((SELECT threshold FROM best), (SELECT threshold FROM lastq)) AS best_threshold,
  {', '.join(f'(SELECT {c} FROM best) AS {c}' for c in EARLY_COLUMNS)},
  (SELECT threshold FROM tab WHERE fpr <= 0.05 ORDER BY f1 DESC, q LIMIT 1) AS f1_threshold,
  (SELECT count(*) FROM tab WHERE fpr <= 0.05) AS feasible""",
    digits={"best_threshold": 6, "f1_threshold": 6, "ewr": 6, "fpr": 6, "f1": 6, "precision": 6, "recall": 6, "mean_dlt": 3},
)
def best_early_threshold(spark, folder):
    df = events(spark, folder)
    table = leadtime.sensitivity(df, sweep.linear_thresholds(df, 100, trim=0.01), medians=False)
    return leadtime.best_early_threshold(table, 0.05)


@query(
    "best_weighted_threshold",
    f"""{per_threshold_sql(grid_sql('percentile', 50, 99.9, 100))}
SELECT q, threshold, f1, ewr, fpr, mean_dlt, 0.3 * f1 + 0.5 * (ewr / 100) - 0.2 * fpr AS objective
FROM tab ORDER BY round(objective, 12) DESC, q LIMIT 1""",
    digits={"threshold": 6, "f1": 6, "ewr": 6, "fpr": 6, "mean_dlt": 3, "objective": 6}, ints=("q",),
)
def best_weighted_threshold(spark, folder):
    df = events(spark, folder)
    table = leadtime.sensitivity(df, sweep.percentile_thresholds(df, 50, 99.9, 100), medians=False)
    best = leadtime.best_weighted_threshold(table)
    return best.select("q", "threshold", "f1", "ewr", "fpr", "mean_dlt", "objective")


@query(
    "validate_then_test",
    f"""WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY us, line_id) - 1 AS pos, count(*) OVER () AS n FROM ev),
val AS (SELECT * FROM o WHERE pos >= CAST(floor(n * 0.5) AS BIGINT) AND pos < CAST(floor(n * 0.5) AS BIGINT) + CAST(floor(n * 0.25) AS BIGINT)),
tst AS (SELECT * FROM o WHERE pos >= CAST(floor(n * 0.5) AS BIGINT) + CAST(floor(n * 0.25) AS BIGINT)),
{grid_sql('percentile', 50, 99.9, 100).replace('FROM ev', 'FROM val')}, {table_sql('>').replace('grid, ev', 'grid, val')},
pk AS (SELECT threshold AS t FROM (SELECT 0 AS turn, threshold, f1, q FROM sw WHERE fpr <= 0.2 AND f1 > 0
       UNION ALL SELECT 1, threshold, 0, -q FROM sw) ORDER BY turn, f1 DESC, q LIMIT 1),
pr AS (SELECT score, label, CASE WHEN score > t THEN 1 ELSE 0 END AS pred, t FROM tst, pk),
c2 AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM tst GROUP BY score),
cu AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c2)
SELECT any_value(t) AS threshold, sum(CASE WHEN pred = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN pred = 1 AND label = 0 THEN 1 ELSE 0 END) AS fp, count(*) AS n,
  (SELECT sum(neg * (tp - pos / 2)) / max(p * n) FROM cu) AS auroc FROM pr""",
    digits={"threshold": 6, "auroc": 6}, ints=("tp", "fp"),
)
def validate_then_test(spark, folder):
    from omenlog.operators import split

    parts = split.chronological(events(spark, folder), (0.5, 0.25, 0.25), cut_rule="parts")
    validation, test = (parts.filter(F.col("part") == p) for p in ("val", "test"))
    t = sweep.best_f1_under_fpr(validation, 0.2).first()["threshold"]
    hit = F.col("score") > t
    row = test.agg(
        F.lit(t).alias("threshold"), F.count_if(hit & (F.col("label") == 1)).alias("tp"),
        F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count("*").alias("n"),
    )
    return row.withColumn("auroc", classify.auroc(test).scalar())


ROI_DIGITS = {"savings": 2, "alarm_cost": 2, "net_benefit": 2, "roi_ratio": 6, "roi_percentage": 4}


@query(
    "return_on_investment",
    f"""{detail_sql(ROWS)}, f AS (SELECT count(*) AS fp FROM ev, thr WHERE score > t AND label = 0),
b AS (SELECT count(*) AS total_failures, sum(CASE WHEN dlt >= 300 THEN 1 ELSE 0 END) AS actionable FROM d),
c AS (SELECT *, CAST(floor(actionable * 0.5) AS BIGINT) AS prevented FROM b, f)
SELECT total_failures, actionable, fp, prevented, prevented * 10000.0 AS savings, fp * 100.0 AS alarm_cost,
  prevented * 10000.0 - fp * 100.0 AS net_benefit, (prevented * 10000.0 - fp * 100.0) / (fp * 100.0) AS roi_ratio,
  ((prevented * 10000.0 - fp * 100.0) / (fp * 100.0) - 1) * 100 AS roi_percentage,
  CAST(floor(prevented * 10000.0 / 100) AS BIGINT) AS breakeven_fp FROM c""",
    digits=ROI_DIGITS, ints=("actionable",),
)
def return_on_investment(spark, folder):
    df = events(spark, folder)
    t = normal_p99(df)
    fp = df.agg(F.count_if((F.col("score") > t) & (F.col("label") == 0))).scalar()
    return leadtime.value_of(leadtime.lead_time(df, t, "rows"), fp)


@query(
    "operational_impact",
    f"""{detail_sql(ROWS)} SELECT 1200.0 AS response_seconds, avg(dlt) AS avg_dlt, coalesce(avg(CASE WHEN dlt > 0 THEN dlt END), 0) AS avg_buffer,
  sum(CASE WHEN dlt > 1200 THEN 1 ELSE 0 END) / count(CASE WHEN dlt > 0 THEN 1 END) * 100 AS adequate_pct,
  greatest(avg(CASE WHEN dlt > 0 THEN dlt END) - 1200, 0) AS time_saved FROM d""",
    digits={"response_seconds": 1, "avg_dlt": 3, "avg_buffer": 3, "adequate_pct": 6, "time_saved": 3},
)
def operational_impact(spark, folder):
    return leadtime.operational_impact(in_rows(spark, folder))


@query(
    "threshold_strictness",
    f"""WITH {EV}, t AS (SELECT quantile_disc(score, 0.9) AS t FROM ev)
SELECT t AS threshold, sum(CASE WHEN score > t THEN 1 ELSE 0 END) AS above, sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS at_or_above
FROM ev CROSS JOIN t GROUP BY t""",
    digits={"threshold": 6}, ints=("above", "at_or_above"),
)
def threshold_strictness(spark, folder):
    df = events(spark, folder)
    n = df.count()
    t = quantile_list(df, F.col("score"), [(-(-9 * n // 10) - 1) / (n - 1)])[0]
    return df.agg(
        F.lit(t).alias("threshold"),
        F.sum(classify.flag(F.col("score"), t, strict=True)).alias("above"),
        F.sum(classify.flag(F.col("score"), t, strict=False)).alias("at_or_above"),
    )
