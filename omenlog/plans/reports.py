"""Run comparisons, written and parsed reports, and the comprehensive report."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.operators import classify, report, split
from omenlog.operators.surprise import long_scores
from omenlog.plans.detection import CURVE, rates_sql
from omenlog.plans.inputs import EV, THR, events, normal_p99, table
from omenlog.plans.leadtime import ROWS, detail_sql
from omenlog.plans.registry import REGISTRY, query
from omenlog.session import new_folder
from omenlog.sources import sinks, text

# Every event kind is read as a run: its scores against the failures of high second score.
RUNS = f"""WITH {EV}, {THR}, rr AS (SELECT kind AS run, CASE WHEN score > 40 THEN 1 ELSE 0 END AS pred, CASE WHEN dist >= 60 THEN 1 ELSE 0 END AS label, score, us, key FROM ev),
cells AS (SELECT run, sum(CASE WHEN pred = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = 1 AND label = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN pred = 0 AND label = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN pred = 0 AND label = 1 THEN 1 ELSE 0 END) AS fn FROM rr GROUP BY run),
rt AS ({rates_sql('cells', 'run,')})"""
METRICS = ("f1", "precision", "recall", "fpr", "fp")
LONG = f"""{RUNS}, mt AS ({' UNION ALL '.join(f"SELECT run, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM rt" for m in METRICS)})"""


def run_rows(spark, folder):
    df = events(spark, folder).withColumn("run", F.col("kind")).withColumn("label", (F.col("dist") >= 60).cast("int"))
    return classify.confusion(df, classify.flag(F.col("score"), 40.0), by=["run"])


def run_metrics(spark, folder):
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return run_rows(spark, folder).select("run", F.explode(cells).alias("m")).select("run", "m.*")


@query(
    "compare_to_baseline",
    f"""{LONG} SELECT m.run, m.metric, b.value AS base, m.value, CASE WHEN b.value <> 0 THEN (m.value - b.value) / b.value * 100 ELSE 0 END AS change_pct,
  CASE WHEN b.value > 0 THEN CASE WHEN m.metric IN ('fpr', 'fp', 'fn') THEN -1 ELSE 1 END * (m.value - b.value) / b.value * 100 ELSE 0 END AS improvement_pct
FROM mt AS m JOIN mt AS b ON m.metric = b.metric AND b.run = 'click' WHERE m.run <> 'click'""",
    digits={"base": 6, "value": 6, "change_pct": 5, "improvement_pct": 5},
)
def compare_to_baseline(spark, folder):
    return report.compare_to_baseline(run_metrics(spark, folder), "click")


@query(
    "best_run_per_metric",
    f"""{LONG}, s AS (SELECT *, CASE WHEN metric IN ('fpr', 'fp') THEN -value ELSE value END AS good FROM mt)
SELECT metric, run, value FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY good DESC, run) = 1""",
    digits={"value": 6},
)
def best_run_per_metric(spark, folder):
    directions = {"f1": "max", "precision": "max", "recall": "max", "fpr": "min", "fp": "min"}
    return report.best_run_per_metric(run_metrics(spark, folder), directions)


@query(
    "metrics_by_experiment",
    f"""WITH {EV}, s AS (SELECT kind AS experiment, hour(ts) AS seed, avg(score) AS mean_score, max(score) AS top_score FROM ev GROUP BY 1, 2),
m AS (SELECT experiment, 'mean_score' AS metric, mean_score AS value FROM s UNION ALL SELECT experiment, 'top_score', top_score FROM s)
SELECT experiment, metric, count(*) AS runs, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max FROM m GROUP BY 1, 2""",
    digits={"mean": 6, "std": 6, "min": 6, "max": 6},
)
def metrics_by_experiment(spark, folder):
    runs = events(spark, folder).groupBy(F.col("kind").alias("experiment"), F.hour("ts").alias("seed")).agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("top_score")
    )
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean_score", "top_score")])
    return report.by_experiment(runs.select("experiment", F.explode(cells).alias("m")).select("experiment", "m.*"))


@query(
    "leaderboard",
    f"""WITH {EV}, s AS (SELECT kind AS model, CAST(key AS VARCHAR) AS file, max(score) AS best_F1 FROM ev GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY best_F1 DESC, file) AS place FROM s) WHERE place <= 10""",
    digits={"best_F1": 6}, ints=("place",),
)
def leaderboard(spark, folder):
    runs = events(spark, folder).groupBy(F.col("kind").alias("model"), F.col("key").cast("string").alias("file")).agg(
        F.max("score").alias("best_F1")
    )
    return report.leaderboard(runs, 10)


@query(
    "value_against_baseline",
    f"""{RUNS}, e AS (SELECT kind AS run, avg(CASE WHEN dist >= 50 THEN 1.0 ELSE 0 END) AS ewr, avg(dist) AS mean_dlt FROM ev GROUP BY 1),
x AS (SELECT run, tp, fp, ewr, mean_dlt FROM rt JOIN e USING (run)), b AS (SELECT * FROM x WHERE run = 'click')
SELECT x.run, (b.fp - x.fp) * 100.0 AS fp_savings, (x.tp * x.ewr - b.tp * b.ewr) * 1400 AS early_value,
  (x.mean_dlt - b.mean_dlt) / 3600 * 10000 * x.tp AS lead_value,
  (b.fp - x.fp) * 100.0 + (x.tp * x.ewr - b.tp * b.ewr) * 1400 + (x.mean_dlt - b.mean_dlt) / 3600 * 10000 * x.tp AS total_value FROM x, b WHERE x.run <> 'click'""",
    digits={"fp_savings": 2, "early_value": 4, "lead_value": 4, "total_value": 4},
)
def value_against_baseline(spark, folder):
    extra = events(spark, folder).groupBy(F.col("kind").alias("run")).agg(
        F.avg((F.col("dist") >= 50).cast("double")).alias("ewr"), F.avg("dist").alias("mean_dlt")
    )
    return report.value_against_baseline(run_rows(spark, folder).join(extra, "run"), "click")


@query(
    "metrics_within_tolerance",
    f"""{LONG}, t(metric, target) AS (VALUES ('f1', 0.4), ('recall', 0.37), ('fpr', 0.36)), c AS (SELECT metric, value FROM mt WHERE run = 'error')
SELECT metric, value, CAST(target AS DOUBLE) AS target, CASE WHEN abs(value - target) / target <= 0.02 THEN 1 ELSE 0 END AS passed FROM c JOIN t USING (metric)""",
    digits={"value": 6, "target": 6}, ints=("passed",),
)
def metrics_within_tolerance(spark, folder):
    targets = spark.createDataFrame([("f1", 0.4), ("recall", 0.37), ("fpr", 0.36)], "metric string, target double")
    measured = run_metrics(spark, folder).filter("run = 'error'").select("metric", "value")
    return report.within_tolerance(measured, targets)


@query(
    "score_distributions",
    f"""WITH {EV}, l AS (SELECT 'score' AS score_name, score FROM ev UNION ALL SELECT 'dist', dist FROM ev), b AS (SELECT avg(score) AS b FROM ev)
SELECT score_name, count(score) AS n, min(score) AS min, max(score) AS max, avg(score) AS mean, stddev_pop(score) AS std, median(score) AS median,
  (avg(score) - any_value(b)) / any_value(b) * 100 AS mean_diff_pct FROM l, b GROUP BY score_name""",
    digits={"min": 4, "max": 4, "mean": 6, "std": 6, "median": 4, "mean_diff_pct": 5},
)
def score_distributions(spark, folder):
    return report.score_summary(long_scores(events(spark, folder), ["score", "dist"]), "score")


@query(
    "parsed_reports",
    """SELECT conv_id, turn, length(text) / 10000.0 AS auroc, length(text) / 20000.0 AS best_f1, length(text) / 5000.0 AS f1 FROM conversations""",
    digits={"auroc": 6, "best_f1": 6, "f1": 4},
)
def parsed_reports(spark, folder):
    """Report texts made from the conversations (their text stands before the figures)."""
    n = F.length("text")
    body = F.format_string(
        "AUROC: %.6f\nbest_F1: %.6f\n\n           1     0.5000    0.2500    %.4f       %d\n%s",
        n / 10000.0, n / 20000.0, n / 5000.0, n, F.regexp_replace("text", r"(?m)^\s*(1 |AUROC:|best_F1:)", "- "),
    )
    df = table(spark, folder, "conversations").select("conv_id", "turn", body.alias("body"))
    found = report.report_columns(F.col("body"))
    return df.select(
        "conv_id", "turn", found["AUROC"].alias("auroc"), found["best_F1"].alias("best_f1"), found["F1_score"].alias("f1")
    )


@query(
    "written_reports_compared",
    f"""{RUNS}, c AS (SELECT run, score, sum(label) AS pos, sum(1 - label) AS neg FROM rr GROUP BY 1, 2),
u AS (SELECT run, pos, neg, sum(pos) OVER (PARTITION BY run ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY run) AS p, sum(neg) OVER (PARTITION BY run) AS n FROM c),
a AS (SELECT run, sum(neg * (tp - pos / 2)) / max(p * n) AS auroc FROM u GROUP BY run)
SELECT run AS model, 'events' AS file, auroc AS "AUROC", f1 AS "best_F1", precision AS "Precision", recall AS "Recall", f1 AS "F1_score" FROM rt JOIN a USING (run)""",
    digits={"AUROC": 6, "best_F1": 6, "Precision": 4, "Recall": 4, "F1_score": 4},
)
def written_reports_compared(spark, folder):
    """Reports written as text, one per run, then read back from their folder."""
    rows = run_rows(spark, folder)
    marked = events(spark, folder).select(F.col("kind").alias("run"), (F.col("dist") >= 60).cast("int").alias("label"), "score")
    full = rows.join(classify.auroc(marked, by=["run"]), "run").withColumns(
        {"best_f1": F.col("f1"), "best_threshold": F.lit(40.0), "model": F.col("run"), "file": F.lit("events")}
    )
    path = new_folder(spark, "reports")
    sinks.write_reports(report.report_text(full), path)
    read = spark.read.text(path, wholetext=True)
    return read.select("model", "file", *[c.alias(n) for n, c in report.report_columns(F.col("value")).items()]).drop("best_threshold")


@query(
    "label_csv_source",
    """SELECT CAST(o_orderkey AS VARCHAR) AS block, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders""",
    ints=("label",),
)
def label_csv_source(spark, folder):
    path = new_folder(spark, "labels")
    word = F.when(F.col("o_orderstatus") == "F", " ANOMALY ").otherwise("Normal")
    table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("BlockId"), word.alias("Label")
    ).write.option("header", True).csv(path)
    return text.read_block_labels(spark, path)


@query(
    "times_kept_with_rows",
    f"WITH {EV} SELECT line_id, us, score FROM ev",
)
def times_kept_with_rows(spark, folder):
    path = new_folder(spark, "events")
    sinks.write_events(events(spark, folder).select("line_id", "ts", "us", "score"), path)
    return spark.read.parquet(path).select("line_id", "us", "score")


@query(
    "score_sink",
    f"WITH {EV} SELECT line_id, 'score' AS score_name, score FROM ev UNION ALL SELECT line_id, 'dist', dist FROM ev",
    digits={"score": 4},
)
def score_sink(spark, folder):
    path = new_folder(spark, "scores")
    sinks.write_scores(long_scores(events(spark, folder), ["score", "dist"]), path)
    return spark.read.parquet(path)


@query(
    "split_sink",
    f"""WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY us, line_id) - 1 AS pos, count(*) OVER () AS n FROM ev)
SELECT line_id, label, CASE WHEN pos < floor(n * 0.8) AND label = 0 THEN 'train' ELSE 'test' END AS role FROM o""",
    ints=("label",),
)
def split_sink(spark, folder):
    path = new_folder(spark, "split")
    sinks.write_split(split.line_split(events(spark, folder)).select("line_id", "label", "role"), path)
    return spark.read.parquet(path)


@query(
    "split_statistics_sink",
    f"""WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY us, line_id) - 1 AS pos, count(*) OVER () AS n FROM ev),
r AS (SELECT label, CASE WHEN pos < floor(n * 0.8) AND label = 0 THEN 'train' ELSE 'test' END AS role FROM o)
SELECT count(CASE WHEN role = 'train' THEN 1 END) AS train_normal, count(CASE WHEN role = 'test' THEN 1 END) AS test_total,
  count(CASE WHEN role = 'test' AND label = 1 THEN 1 END) AS test_anomaly, count(CASE WHEN role = 'test' AND label = 0 THEN 1 END) AS test_normal FROM r""",
)
def split_statistics_sink(spark, folder):
    path = new_folder(spark, "statistics")
    sinks.write_statistics(split.split_statistics(split.line_split(events(spark, folder))), path)
    schema = "train_normal long, test_total long, test_anomaly long, test_normal long"
    return spark.read.schema(schema).json(path)


@query(
    "comprehensive_report",
    f"""{detail_sql(ROWS)}, hw AS (SELECT us - us % 3600000000 AS w, sum(CASE WHEN score > t THEN 1 ELSE 0 END) AS alerts, sum(label) AS failures FROM ev, thr GROUP BY 1),
c AS (SELECT sum(CASE WHEN score > t AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score > t AND label = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN NOT score > t AND label = 1 THEN 1 ELSE 0 END) AS fn, any_value(t) AS threshold FROM ev, thr)
SELECT threshold, tp, fp, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS f1,
  (SELECT avg(dlt) FROM d) AS mean_dlt, (SELECT avg(CASE WHEN dlt >= 300 THEN 100.0 ELSE 0 END) FROM d) AS ewr_5min,
  (SELECT count(*) FROM hw WHERE alerts > 0) AS hour_alert_windows,
  (SELECT sum(CASE WHEN dlt >= 300 THEN 1 ELSE 0 END) FROM d) // 2 * 10000.0 - fp * 100.0 AS net_benefit, 'not ready' AS recommendation FROM c""",
    digits={"threshold": 6, "f1": 6, "mean_dlt": 3, "ewr_5min": 5, "net_benefit": 2}, ints=("tp", "fp"),
)
def comprehensive_report(spark, folder):
    df = events(spark, folder)
    out = report.comprehensive(df, normal_p99(df))
    return out.select(
        "threshold", "quality.tp", "quality.fp", "quality.f1", "lead_time.mean_dlt", "lead_time.ewr_5min",
        F.col("windows")[1]["alert_windows"].alias("hour_alert_windows"), "roi.net_benefit", "recommendation",
    )


@query(
    "report_headline",
    f"""WITH {EV}, {CURVE}, a AS (SELECT sum(neg * (tp - pos / 2)) / max(p * n) AS auroc FROM cur),
rep AS ({REGISTRY["comprehensive_report"].sql})
SELECT printf('F1=%.3f, AUROC=%.3f', f1, auroc) AS detection_quality,
  printf('EWR(5min)=%.1f%%, Mean DLT=%.1fmin', ewr_5min, mean_dlt / 60) AS early_warning_capability,
  'ROI=' || CASE WHEN fp > 0 THEN printf('%.0f', (net_benefit / (fp * 100.0) - 1) * 100) WHEN net_benefit > 0 THEN 'inf' ELSE '-100' END
    || '%, Net Benefit=$' || format('{{:,}}', CAST(round(net_benefit) AS BIGINT)) AS business_value,
  recommendation FROM rep, a""",
)
def report_headline(spark, folder):
    df = events(spark, folder)
    return report.headline(report.comprehensive(df, normal_p99(df)))


@query("comprehensive_report_nested")
def comprehensive_report_nested(spark, folder):
    df = events(spark, folder)
    out = report.comprehensive(df, normal_p99(df))
    return out.select(F.to_json(F.struct(*out.columns)).alias("report"))
