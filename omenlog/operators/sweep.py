"""Threshold sweeps: every threshold of a grid is answered by one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omenlog.operators import blends
from omenlog.operators.classify import auroc, rates
from omenlog.operators.order import numbers, quantile_list, quantiles, search
from omenlog.session import checkpointed


def linear(low: float, high: float, n: int) -> list[float]:
    """``n`` evenly spaced numbers from low to high, both included."""
    if n == 1:
        return [float(low)]
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [float(high)]


def percentile_grid(low: float, high: float, n: int) -> list[float]:
    """Probabilities of an evenly spaced percentile grid."""
    return [p / 100.0 for p in linear(low, high, n)]


def percentile_thresholds(df: DataFrame, low: float, high: float, n: int) -> list[float]:
    """Exact score percentiles on an evenly spaced grid."""
    return quantile_list(df, F.col("score"), percentile_grid(low, high, n))


def linear_thresholds(df: DataFrame, n: int, trim: float = 0.0) -> list[float]:
    """Evenly spaced thresholds over the score range, trimmed at both ends."""
    row = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if row["lo"] is None:
        return []
    margin = trim * (row["hi"] - row["lo"])
    return linear(row["lo"] + margin, row["hi"] - margin, n)


def passed(score: Column, grid: Sequence[float], strict: bool) -> Column:
    """How many grid values the score passes (grid ascending and distinct).

    The place of a score in an evenly spaced grid is computed and then corrected by the
    neighbouring values; in any other grid it is found by halving.
    """
    step = (grid[-1] - grid[0]) / (len(grid) - 1) if len(grid) > 1 else 0.0
    even = step > 0 and all(abs(grid[0] + i * step - t) <= 1e-6 * step for i, t in enumerate(grid))
    if even:
        table, last = numbers(grid), len(grid) - 1
        near = F.greatest(F.lit(0.0), F.least(F.lit(float(last)), F.floor((score - grid[0]) / step))).cast("int")
        near = F.when(F.isnan(score), F.lit(last)).otherwise(near)

        def beats(at: Column) -> Column:
            bound = F.get(table, at)
            return F.coalesce((score > bound) if strict else (score >= bound), F.lit(False))

        return F.greatest(near - 1, F.lit(0)) + sum(
            (F.when(beats(F.greatest(near - 1, F.lit(0)) + i), 1).otherwise(0) for i in range(3)), F.lit(0))
    return search(numbers(grid), len(grid).bit_length() + 1, score, F.lit(len(grid)), strict=strict)


def sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    *,
    strict: bool = True,
    score: Column | None = None,
) -> DataFrame:
    """Confusion counts and rates for every threshold: rows ``q, threshold, tp, ...``.

    Rows are counted by how many thresholds they pass (partial aggregation leaves at most
    ``len(thresholds) + 1`` groups per task) and the counts are summed from the top.
    """
    score = F.col("score") if score is None else score
    grid = sorted({float(t) for t in thresholds})
    bins = df.groupBy(passed(score, grid, strict).alias("b")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    spark = df.sparkSession
    place = {t: i for i, t in enumerate(grid)}
    wanted = spark.createDataFrame(
        [(q, float(t), place[float(t)] + 1) for q, t in enumerate(thresholds)],
        "q int, threshold double, b int",
    )
    levels = spark.range(len(grid) + 1).select(F.col("id").cast("int").alias("b"))
    down = Window.orderBy(F.col("b").desc())  # one row per value of the grid
    sums = levels.join(F.broadcast(bins), "b", "left").select(
        "b",
        F.sum(F.coalesce("pos", F.lit(0))).over(down).alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(down).alias("fp"),
    )
    everything = Window.partitionBy()
    sums = sums.withColumns({"p": F.max("tp").over(everything), "n": F.max("fp").over(everything)})
    found = wanted.join(F.broadcast(sums), "b").select(
        "q", "threshold", "tp", "fp",
        (F.col("n") - F.col("fp")).alias("tn"),
        (F.col("p") - F.col("tp")).alias("fn"),
    )
    return found.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def best_by_f1(table: DataFrame) -> DataFrame:
    """First row with the highest F1 (grid order)."""
    row = F.struct(*table.columns)
    return table.agg(F.max_by(row, F.struct("f1", -F.col("q"))).alias("r")).select("r.*")


def best_f1_under_fpr(
    df: DataFrame,
    target_fpr: float = 0.01,
    *,
    low: float = 50.0,
    high: float = 99.9,
    n: int = 100,
    fallback: str = "highest",
) -> DataFrame:
    """Highest F1 among percentile thresholds whose FPR meets the target.

    With no feasible threshold (or no F1 above 0) the fallback is the ``highest``
    threshold of the grid or the first one with the ``min_fpr``.
    """
    table = sweep(df, percentile_thresholds(df, low, high, n))
    row = F.struct(*table.columns)
    feasible = (F.col("fpr") <= target_fpr) & (F.col("f1") > 0)
    other = (
        F.max_by(row, F.col("q"))
        if fallback == "highest"
        else F.max_by(row, F.struct(-F.col("fpr"), -F.col("q")))
    )
    picked = table.agg(
        F.max_by(row, F.when(feasible, F.struct(F.col("f1"), -F.col("q")))).alias("best"),
        other.alias("other"),
        F.count_if(F.col("fpr") <= target_fpr).alias("feasible"),
    )
    return picked.select(F.coalesce("best", "other").alias("r"), "feasible").select("r.*", "feasible")


def min_max(df: DataFrame, *columns: str) -> dict[str, tuple[float, float]]:
    """Global minimum and maximum of each column (one aggregation, two numbers each)."""
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def scaled(value: Column, low: float | Column, high: float | Column) -> Column:
    """Min-max scaling to [0, 1]; a degenerate range gives 0."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(hi - lo < 1e-8, F.lit(0.0)).otherwise((value - lo) / (hi - lo))


def blend(a: Column, b: Column, alpha: float | Column) -> Column:
    """``alpha * a + (1 - alpha) * b``."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return alpha * a + (F.lit(1.0) - alpha) * b


def equal_pairs(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``label, _a, _b, n``: the rows to be blended, equal ones counted (``n``), as a written table."""
    return checkpointed(df.groupBy("label", a.cast("double").alias("_a"), b.cast("double").alias("_b")).agg(F.count("*").alias("n")))


def _mixed(pairs: DataFrame, alphas: Sequence[float]) -> DataFrame:
    mixes = F.array(*[
        F.struct(F.lit(i).alias("alpha_no"), blend(F.col("_a"), F.col("_b"), x).alias("score"))
        for i, x in enumerate(alphas)
    ])
    return pairs.select("label", "n", F.explode(mixes).alias("m")).select(
        F.col("m.alpha_no").alias("alpha_no"), F.col("m.score").alias("score"), "label", "n"
    )


def by_alpha(df: DataFrame, a: Column, b: Column, alphas: Sequence[float]) -> DataFrame:
    """``alpha_no, score, label, n`` for every blend; equal rows are counted (``n``) before they are blended."""
    return _mixed(equal_pairs(df, a, b), alphas)


def _named(spark, alphas: Sequence[float]) -> DataFrame:
    return F.broadcast(
        spark.createDataFrame([(i, float(a)) for i, a in enumerate(alphas)], "alpha_no int, alpha double")
    )


def _sweep_per_alpha(pairs: DataFrame, alphas: Sequence[float], grids: dict[int, list[float]], strict: bool) -> DataFrame:
    """Counts for a grid per alpha: ``alpha_no, q, threshold, tp, fp, tn, fn`` and rates."""
    tables = {i: sorted(set(g)) for i, g in grids.items()}
    bins = blends.passed(pairs, alphas, tables, strict)
    spark = pairs.sparkSession
    wanted = spark.createDataFrame(
        [(i, q, float(t), tables[i].index(float(t)) + 1) for i, g in grids.items() for q, t in enumerate(g)],
        "alpha_no int, q int, threshold double, b int",
    )
    levels = spark.createDataFrame(
        [(i, b) for i, g in tables.items() for b in range(len(g) + 1)], "alpha_no int, b int"
    )
    down = Window.partitionBy("alpha_no").orderBy(F.col("b").desc())
    whole = Window.partitionBy("alpha_no")
    sums = levels.join(bins, ["alpha_no", "b"], "left").select(
        "alpha_no", "b",
        F.sum(F.coalesce("pos", F.lit(0))).over(down).alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(down).alias("fp"),
    ).withColumns({"p": F.max("tp").over(whole), "n": F.max("fp").over(whole)})
    found = wanted.join(sums, ["alpha_no", "b"]).select(
        "alpha_no", "q", "threshold", "tp", "fp",
        (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"),
    )
    return found.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def alpha_sweep(df: DataFrame, a: str, b: str, alphas: Sequence[float], n: int = 1000) -> DataFrame:
    """Per alpha: AUROC and the best-F1 row on a linear grid (``>=``) of the blended score."""
    span = min_max(df, a, b)
    pairs = equal_pairs(df, scaled(F.col(a), *span[a]), scaled(F.col(b), *span[b]))
    mixed = _mixed(pairs, alphas)
    ends = {
        r["alpha_no"]: (r["lo"], r["hi"])
        for r in mixed.groupBy("alpha_no").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    }
    table = _sweep_per_alpha(pairs, alphas, {i: linear(*ends[i], n) for i in sorted(ends)}, strict=False)
    row = F.struct(*table.columns)
    best = table.groupBy("alpha_no").agg(F.max_by(row, F.struct("f1", -F.col("q"))).alias("r")).select("r.*")
    areas = blends.auroc(pairs, alphas)
    if areas is None:
        areas = auroc(mixed, by=["alpha_no"], weight=F.col("n"))
    return best.join(areas, "alpha_no").join(_named(df.sparkSession, alphas), "alpha_no")


def best_alpha(pairs: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Best percentile-grid F1 (101 points, ``>``) per alpha, with the overall winner marked.

    ``pairs`` are the rows to be blended (see ``equal_pairs``).  Ties go to the lower alpha; if no
    alpha reaches an F1 above 0 there is no winner.
    """
    probs = percentile_grid(0, 100, 101)
    grids = blends.quantiles(pairs, alphas, probs)
    if grids is None:
        mixed, grids = _mixed(pairs, alphas), {}
        cells = quantiles(mixed, F.col("score"), probs, keys=["alpha_no"], weight=F.col("n")).collect()  # 101 per alpha
        for r in sorted(cells, key=lambda r: (r["alpha_no"], r["q"])):
            grids.setdefault(r["alpha_no"], []).append(r["value"])
    table = _sweep_per_alpha(pairs, alphas, grids, strict=True)
    per_alpha = table.groupBy("alpha_no").agg(F.max("f1").alias("f1"))
    order = Window.orderBy(F.col("f1").desc(), F.col("alpha_no"))  # one row per alpha
    return per_alpha.select(
        "alpha_no", "f1",
        ((F.row_number().over(order) == 1) & (F.col("f1") > 0)).cast("int").alias("is_best"),
    ).join(_named(pairs.sparkSession, alphas), "alpha_no")
