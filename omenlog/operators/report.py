"""Reports: parsing written ones, comparing runs, leaderboards, the comprehensive report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omenlog.functions.scoring import recommendation
from omenlog.operators import alerts, classify, leadtime
from omenlog.operators.order import Order, quantiles
from omenlog.operators.temporal import side_by_side
from omenlog.session import checkpointed

NUMBER = r"([-+0-9.eE]+)"
LOWER_IS_BETTER = ("fpr", "fp", "fn")


def report_columns(text: Column) -> dict[str, Column]:
    """Metrics of one report text; null where a line is missing."""

    def found(pattern: str) -> Column:
        value = F.regexp_extract(text, pattern, 1)
        return F.when(value != "", value).try_cast("double")

    row = r"(?m)^\s*1\s+"
    return {
        "AUROC": found(r"(?m)^AUROC:\s*" + NUMBER),
        "best_F1": found(r"(?m)^best_F1:\s*" + NUMBER),
        "best_threshold": found(r"(?m)^best_threshold:\s*" + NUMBER),
        "Precision": found(row + NUMBER),
        "Recall": found(row + r"[-+0-9.eE]+\s+" + NUMBER),
        "F1_score": found(row + r"[-+0-9.eE]+\s+[-+0-9.eE]+\s+" + NUMBER),
    }


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports below ``<runs>/<model>/results/<file>_report.txt`` as one row each."""
    raw = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path")
    )
    return raw.select(
        F.regexp_extract("path", r"([^/]+)/results/[^/]+$", 1).alias("model"),
        F.regexp_extract("path", r"([^/]+)_report\.txt$", 1).alias("file"),
        *[c.alias(n) for n, c in report_columns(F.col("value")).items()],
    )


def report_text(row: DataFrame) -> DataFrame:
    """The text of a report from its metrics (columns auroc, best_f1, best_threshold, ...)."""
    return row.withColumn(
        "text",
        F.format_string(
            "AUROC: %.6f\nbest_F1: %.6f\nbest_threshold: %s\n\nconfusion_matrix:\n[[%d %d]\n [%d %d]]\n\n"
            "              precision    recall  f1-score   support\n\n           1     %.4f    %.4f    %.4f %9d\n",
            "auroc", "best_f1", F.col("best_threshold").cast("string"), "tn", "fp", "fn", "tp",
            "precision", "recall", "f1", F.col("tp") + F.col("fn"),
        ),
    )


def leaderboard(runs: DataFrame, n: int = 10, *, metric: str = "best_F1") -> DataFrame:
    """Top ``n`` runs per model, best first (ties by file name)."""
    w = Window.partitionBy("model").orderBy(F.col(metric).desc(), "file")
    return runs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def best_run_per_metric(metrics: DataFrame, directions: dict[str, str]) -> DataFrame:
    """Best run per metric (``run, metric, value``); ties go to the first run by name."""
    signs = F.coalesce(*[F.when(F.col("metric") == m, F.lit(1 if d == "max" else -1)) for m, d in directions.items()])
    ranked = metrics.filter(F.col("metric").isin(list(directions))).withColumn("good", signs * F.col("value"))
    top = ranked.groupBy("metric").agg(F.max("good").alias("top"))
    return ranked.join(F.broadcast(top), "metric").filter(F.col("good") == F.col("top")).groupBy("metric").agg(
        F.min_by(F.struct("run", "value"), "run").alias("b")
    ).select("metric", F.col("b.run").alias("run"), F.col("b.value").alias("value"))


def compare_to_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Change of every run against the baseline run, in percent and as an improvement.

    ``improvement`` turns the sign for metrics where lower is better; a baseline of 0
    (or below, for improvements) gives 0.
    """
    base = metrics.filter(F.col("run") == baseline).select("metric", F.col("value").alias("base"))
    both = metrics.filter(F.col("run") != baseline).join(F.broadcast(base), "metric")
    change = (F.col("value") - F.col("base")) / F.col("base") * 100
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1).otherwise(1)
    return both.select(
        "run", "metric", "base", "value",
        F.when(F.col("base") != 0, change).otherwise(0.0).alias("change_pct"),
        F.when(F.col("base") > 0, sign * change).otherwise(0.0).alias("improvement_pct"),
    )


def value_against_baseline(
    runs: DataFrame, baseline: str, *, alarm_cost: float = 100.0, warning_value: float = 1400.0,
    downtime_per_hour: float = 10000.0,
) -> DataFrame:
    """Worth of a run over the baseline: fewer false alarms, earlier warnings, lead time.

    ``runs`` has ``run, tp, fp, ewr, mean_dlt`` (ewr as a fraction).
    """
    names = ("tp", "fp", "ewr", "mean_dlt")
    base = runs.filter(F.col("run") == baseline).select(F.struct(*names)).scalar()
    out = runs.filter(F.col("run") != baseline).withColumn("_b", base)
    b = {n: F.col("_b")[n] for n in names}
    out = out.select(
        "run",
        ((b["fp"] - F.col("fp")) * F.lit(alarm_cost)).alias("fp_savings"),
        ((F.col("tp") * F.col("ewr") - b["tp"] * b["ewr"]) * F.lit(warning_value)).alias("early_value"),
        ((F.col("mean_dlt") - b["mean_dlt"]) / 3600 * F.lit(downtime_per_hour) * F.col("tp")).alias("lead_value"),
    )
    return out.withColumn("total_value", F.col("fp_savings") + F.col("early_value") + F.col("lead_value"))


def within_tolerance(metrics: DataFrame, targets: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Whether each metric lies within the relative tolerance of its target."""
    off = F.abs(F.col("value") - F.col("target")) / F.abs("target")
    return metrics.join(F.broadcast(targets), "metric").select(
        "metric", "value", "target", (off <= tolerance).cast("int").alias("passed")
    )


def by_experiment(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric per experiment, over its seeds."""
    return metrics.groupBy("experiment", "metric").agg(
        F.count("*").alias("runs"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def score_summary(long: DataFrame, baseline: str | None = None) -> DataFrame:
    """Distribution of each score and its mean difference to the baseline score in percent."""
    medians = quantiles(long, F.col("score"), [0.5], keys=["score_name"]).select(
        "score_name", F.col("value").alias("median")
    )
    stats = long.groupBy("score_name").agg(
        F.count("score").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
    ).join(medians, "score_name")
    if baseline is None:
        return stats
    base = long.filter(F.col("score_name") == baseline).agg(F.avg("score")).scalar()
    return stats.withColumn("mean_diff_pct", (F.col("mean") - base) / base * 100)


def comprehensive(
    df: DataFrame,
    threshold: float,
    *,
    windows: Sequence[str] = ("30 minutes", "1 hour", "6 hours"),
    failure_cost: float = 10000.0,
    alarm_cost: float = 100.0,
    response_seconds: float = 1200.0,
    order: Order | None = None,
) -> DataFrame:
    """One row of nested structs: quality, lead time, alert fatigue, value, summary."""
    order = order or Order()
    hit = classify.flag(F.col("score"), threshold)
    df = checkpointed(df)
    raw = checkpointed(leadtime.lead_time(df, threshold, "rows_raw", order=order))
    clamped = raw.withColumn("dlt", F.greatest("dlt", F.lit(0.0)))

    quality = side_by_side(classify.confusion(df, hit), classify.auroc(df))
    lead = leadtime.summary(clamped)
    bins = leadtime.categories(clamped).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "failures")))).alias("v")
    )
    points = leadtime.percentiles(clamped).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("percentile")).alias("k"), "dlt")))).alias("v")
    )
    calendar = leadtime.by_calendar(raw).agg(F.collect_list(F.struct("*")).alias("v"))  # at most 31 slots
    fp = df.agg(F.count_if((hit == 1) & (F.col("label") == 0))).scalar()
    roi = leadtime.value_of(raw, fp, failure_cost=failure_cost, alarm_cost=alarm_cost)
    impact = leadtime.operational_impact(raw, response_seconds)

    def one(row: DataFrame) -> Column:
        return row.select(F.struct(*row.columns)).scalar()

    precision = checkpointed(alerts.window_precision(df, hit, *windows))
    fatigue = [one(precision.filter(F.col("window_size") == w)) for w in windows]
    report = df.sparkSession.range(1).select(
        F.lit(float(threshold)).alias("threshold"),
        one(quality).alias("quality"), one(lead).alias("lead_time"),
        bins.select("v").scalar().alias("categories"), points.select("v").scalar().alias("percentiles"),
        calendar.select("v").scalar().alias("calendar"),
        F.array(*fatigue).alias("windows"),
        one(alerts.concentration(df, hit, order=order)).alias("concentration"),
        one(roi).alias("roi"), one(impact).alias("operational"),
    )
    return report.withColumn(
        "recommendation",
        recommendation(F.col("quality.f1"), F.col("lead_time.ewr_5min"), F.col("roi.roi_ratio")),
    )


def headline(report: DataFrame) -> DataFrame:
    """The comprehensive report in a line per question: detection, early warning, value, advice.

    A figure that the report does not have (no failures, say) is written as ``n/a``.
    """

    def figure(pattern: str, value: Column) -> Column:
        endless = F.abs(value) == float("inf")
        return F.when(value.isNull() | F.isnan(value), "n/a").when(endless, "inf").otherwise(F.format_string(pattern, value))

    lead, roi = F.col("lead_time"), F.col("roi")
    return report.select(
        F.concat(F.lit("F1="), figure("%.3f", F.col("quality.f1")), F.lit(", AUROC="), figure("%.3f", F.col("quality.auroc")))
        .alias("detection_quality"),
        F.concat(F.lit("EWR(5min)="), figure("%.1f", lead["ewr_5min"]), F.lit("%, Mean DLT="),
                 figure("%.1f", lead["mean_dlt"] / 60), F.lit("min")).alias("early_warning_capability"),
        F.concat(F.lit("ROI="), figure("%.0f", roi["roi_percentage"]), F.lit("%, Net Benefit=$"),
                 figure("%,.0f", roi["net_benefit"].cast("double"))).alias("business_value"),
        "recommendation",
    )
