"""Detection quality at one threshold and over all thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.order import Order, running

EPSILON = 1e-12


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` with 0/0 read as 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Derived rates of a confusion matrix."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
    }


def flag(score: Column, threshold: Column | float, *, strict: bool = True) -> Column:
    """1 where the score passes the threshold (``>`` if strict, else ``>=``)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return ((score > t) if strict else (score >= t)).cast("int")


def confusion(df: DataFrame, predicted: Column, *, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix and rates; one row per ``by``."""
    truth = F.col("label") == 1
    hit = predicted == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & ~truth).alias("tn"),
        F.count_if(~hit & truth).alias("fn"),
    )
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def class_report(df: DataFrame, predicted: Column) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = df.groupBy("label", predicted.alias("pred")).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("cls"), F.lit(0).alias("is_pred"), "label", "pred", "n"),
                F.struct(F.col("pred").alias("cls"), F.lit(1).alias("is_pred"), "label", "pred", "n"),
            )
        ).alias("s")
    ).select("s.*")
    hit = F.col("label") == F.col("pred")
    per_class = sides.groupBy("cls").agg(
        F.coalesce(F.sum(F.when((F.col("is_pred") == 0) & hit, F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("is_pred") == 0, F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("is_pred") == 1, F.col("n"))), F.lit(0)).alias("predicted"),
    )
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    rows = per_class.select(
        F.col("cls").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
    )
    measures = ("precision", "recall", "f1")
    macro = rows.agg(
        F.lit("macro avg").alias("class"),
        *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    weighted = rows.agg(
        F.lit("weighted avg").alias("class"),
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted)


def _of_class(value: int, weight: Column | None) -> Column:
    """Rows of a class, each counted ``weight`` times."""
    mine = F.col("label") == value
    return F.count_if(mine) if weight is None else F.coalesce(F.sum(F.when(mine, weight)), F.lit(0))


def score_counts(
    df: DataFrame, *, by: Sequence[str] = (), score: str = "score", weight: Column | None = None,
) -> DataFrame:
    """Positives and negatives per distinct score: all that any curve needs."""
    return df.groupBy(*by, score).agg(
        _of_class(1, weight).alias("pos"), _of_class(0, weight).alias("neg")
    )


def curve(
    df: DataFrame, *, by: Sequence[str] = (), score: str = "score", weight: Column | None = None,
) -> DataFrame:
    """One row per distinct score, taken as a ``>=`` threshold: counts and the P/N totals."""
    counts = score_counts(df, by=by, score=score, weight=weight)
    steps = running(
        counts,
        Order(tuple(by), (score,)),
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
        reverse=True,
    )
    # Summed from the rows, not from the counts: partial sums stay on the map side.
    totals = df.groupBy(*by).agg(
        _of_class(1, weight).alias("p"), _of_class(0, weight).alias("n")
    )
    if by:
        return steps.join(totals, list(by))
    both = totals.select(F.struct("p", "n")).scalar()
    return steps.withColumn("_pn", both).withColumns(
        {"p": F.col("_pn.p"), "n": F.col("_pn.n")}
    ).drop("_pn")


def roc(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """ROC points: threshold, tpr, fpr; the curve starts at (0, 0), one above the highest score."""
    points = curve(df, by=by).select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("n")).alias("fpr"),
        ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )
    start = df.groupBy(*by).agg((F.max("score") + 1).cast("double").alias("threshold")).filter("threshold IS NOT NULL")
    return points.unionByName(start.withColumns({"fpr": F.lit(0.0), "tpr": F.lit(0.0)}))


def auroc(
    df: DataFrame, *, by: Sequence[str] = (), score: str = "score", weight: Column | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Area under the ROC curve, ties counted half.  ``steps`` is the ``curve`` of ``df``, if it is known."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    steps = curve(df, by=by, score=score, weight=weight) if steps is None else steps
    return steps.groupBy(*by).agg(
        ratio(area, (F.max("p") * F.max("n")).cast("double")).alias("auroc")
    )


def pr_curve(df: DataFrame, *, by: Sequence[str] = (), steps: DataFrame | None = None) -> DataFrame:
    """Precision and recall at every distinct score, with the F1 used for ranking."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("p"))
    before = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    earlier = F.when(before[0] + before[1] > 0, before[0] / (before[0] + before[1])).otherwise(1.0)
    return (
        (curve(df, by=by) if steps is None else steps)
        .withColumns({"precision": precision, "recall": recall})
        .withColumn(
            "f1",
            2 * F.col("precision") * F.col("recall")
            / (F.col("precision") + F.col("recall") + F.lit(EPSILON)),
        )
        .withColumn(
            "area",
            ratio(F.col("pos"), F.col("p")) * (F.col("precision") + earlier) / 2,
        )
        .select(*by, F.col("score").alias("threshold"), "precision", "recall", "f1", "area")
    )


def best_f1(df: DataFrame, *, by: Sequence[str] = (), steps: DataFrame | None = None) -> DataFrame:
    """Best-F1 operating point (lowest threshold on ties) and the PR area.  ``steps`` as in ``auroc``."""
    point = F.struct("threshold", "precision", "recall", "f1")
    found = pr_curve(df, by=by, steps=steps).groupBy(*by).agg(
        F.max_by(point, F.struct(F.col("f1"), -F.col("threshold"))).alias("best"),
        F.sum("area").alias("pr_auc"),
    )
    return found.select(
        *by,
        F.col("best.threshold").alias("best_threshold"),
        F.col("best.f1").alias("best_f1"),
        F.col("best.precision").alias("precision"),
        F.col("best.recall").alias("recall"),
        "pr_auc",
    )
