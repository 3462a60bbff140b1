"""Quality at a threshold, curves, threshold sweeps and blends over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.operators import classify, evt, sketch, sweep
from omenlog.operators.order import Order, quantiles, running
from omenlog.plans.inputs import EV, THR, events, normal_p99
from omenlog.plans.registry import query
from omenlog.session import new_folder

COUNTS = """
  sum(CASE WHEN pred = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN pred = 1 AND label = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN pred = 0 AND label = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN pred = 0 AND label = 1 THEN 1 ELSE 0 END) AS fn"""


def rates_sql(source: str, keep: str = "") -> str:
    """Rates over a relation with tp, fp, tn, fn."""
    return f"""
SELECT {keep} tp, fp, tn, fn, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
       CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr,
       CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr,
       CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END AS accuracy
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
      FROM {source})"""


RATE_DIGITS = {c: 6 for c in ("precision", "recall", "f1", "fpr", "fnr", "accuracy")}
CELLS = ("tp", "fp", "tn", "fn")


@query(
    "confusion_at_p99",
    f"WITH {EV}, {THR}, c AS (SELECT {COUNTS} FROM (SELECT *, CASE WHEN score > t THEN 1 ELSE 0 END AS pred "
    f"FROM ev CROSS JOIN thr)) {rates_sql('c')}",
    digits=RATE_DIGITS, ints=CELLS,
)
def confusion_at_p99(spark, folder):
    df = events(spark, folder)
    return classify.confusion(df, classify.flag(F.col("score"), normal_p99(df)))


@query(
    "class_report",
    f"""WITH {EV}, {THR},
p AS (SELECT label, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM ev CROSS JOIN thr),
k AS (SELECT cls, sum(CASE WHEN label = cls AND pred = cls THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS support,
             sum(CASE WHEN pred = cls THEN 1 ELSE 0 END) AS predicted
      FROM p CROSS JOIN (VALUES (0), (1)) AS v(cls) GROUP BY cls),
q AS (SELECT CAST(cls AS VARCHAR) AS class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM k),
r AS (SELECT class, precision, recall,
             CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
             support FROM q)
SELECT * FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM r""",
    digits={"precision": 6, "recall": 6, "f1": 6}, ints=("support",),
)
def class_report(spark, folder):
    df = events(spark, folder)
    return classify.class_report(df, classify.flag(F.col("score"), normal_p99(df)))


CURVE = """cnt AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ev GROUP BY score),
cur AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
               sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cnt)"""


@query(
    "roc_points",
    f"WITH {EV}, {CURVE} SELECT score AS threshold, fp / n AS fpr, tp / p AS tpr FROM cur UNION ALL SELECT max(score) + 1, 0, 0 FROM ev",
    digits={"threshold": 6, "fpr": 6, "tpr": 6},
)
def roc_points(spark, folder):
    return classify.roc(events(spark, folder))


@query(
    "auroc",
    f"WITH {EV}, {CURVE} SELECT sum(neg * (tp - pos / 2)) / max(p * n) AS auroc FROM cur",
    digits={"auroc": 6},
)
def auroc(spark, folder):
    return classify.auroc(events(spark, folder))


PR = """pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall,
  2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-12) AS f1,
  pos / p * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2 AS area
  FROM cur)"""


@query(
    "pr_points",
    f"WITH {EV}, {CURVE}, {PR} SELECT threshold, precision, recall, f1, area FROM pr",
    digits={"precision": 6, "recall": 6, "f1": 6, "area": 8},
)
def pr_points(spark, folder):
    return classify.pr_curve(events(spark, folder))


@query(
    "best_f1_and_pr_auc",
    f"""WITH {EV}, {CURVE}, {PR}
SELECT b.threshold AS best_threshold, b.f1 AS best_f1, b.precision, b.recall, a.pr_auc
FROM (SELECT * FROM pr ORDER BY f1 DESC, threshold LIMIT 1) AS b CROSS JOIN (SELECT sum(area) AS pr_auc FROM pr) AS a""",
    digits={"best_f1": 6, "precision": 6, "recall": 6, "pr_auc": 6},
)
def best_f1_and_pr_auc(spark, folder):
    return classify.best_f1(events(spark, folder))


@query(
    "static_quantile_threshold",
    f"""WITH {EV} SELECT 0.95 AS quantile, quantile_cont(score, 0.95) AS threshold FROM ev
UNION ALL SELECT 0.99, quantile_cont(score, 0.99) FROM ev
UNION ALL SELECT 0.999, quantile_cont(score, 0.999) FROM ev""",
    digits={"quantile": 4, "threshold": 6},
)
def static_quantile_threshold(spark, folder):
    probs = [0.95, 0.99, 0.999]
    found = quantiles(events(spark, folder), F.col("score"), probs)
    return found.select(F.get(F.array(*[F.lit(p) for p in probs]), F.col("q")).alias("quantile"),
                        F.col("value").alias("threshold"))


@query(
    "sketched_thresholds",
    f"""WITH {EV} SELECT unnest([0.95, 0.99, 0.999]) AS quantile, (SELECT count(score) FROM ev) AS n,
(SELECT count(DISTINCT CAST(ts AS DATE)) FROM ev) AS days, CAST(1 AS BIGINT) AS within_error""",
    digits={"quantile": 4}, ints=("n", "days"),
)
def sketched_thresholds(spark, folder):
    """Thresholds from the kept sketches of two loads of days, held against the exact ranks."""
    probs, df, kept = [0.95, 0.99, 0.999], events(spark, folder), new_folder(spark, "sketches")
    for load in (0, 1):
        part = df.filter(F.dayofyear("ts") % 2 == load)
        sketch.keep_days(sketch.daily(part, F.col("score"), F.col("ts")), kept)
    days = sketch.kept_days(spark, kept)
    found = {r["q"]: r for r in sketch.quantiles(days, probs).collect()}
    rows = [(i, p, found[i]["value"], found[i]["n"]) for i, p in enumerate(probs) if i in found]
    ranks = df.agg(
        F.count("score").alias("all"), days.agg(F.count_distinct("day")).scalar().alias("days"),
        F.array(*[F.struct(F.count_if(F.col("score") < v).alias("below"), F.count_if(F.col("score") <= v).alias("up_to"),
                           F.lit(p).alias("quantile"), F.lit(n).alias("n")) for _, p, v, n in rows]).alias("at"),
    )
    wide = F.lit(sketch.rank_error()) * F.col("all")
    close = (F.col("a.below") <= F.col("a.quantile") * F.col("all") + wide) & (F.col("a.up_to") >= F.col("a.quantile") * F.col("all") - wide)
    return ranks.select("all", "days", F.explode("at").alias("a")).select(
        "a.quantile", "a.n", "days", close.cast("long").alias("within_error"))


@query(
    "normal_percentile_threshold",
    f"WITH {EV}, {THR} SELECT t AS threshold, (SELECT count(*) FROM ev, thr WHERE score > t) AS alerts FROM thr",
    digits={"threshold": 6},
)
def normal_percentile_threshold(spark, folder):
    df = events(spark, folder)
    t = normal_p99(df)
    return df.agg(F.lit(t).alias("threshold"), F.count_if(F.col("score") > t).alias("alerts"))


def grid_sql(kind: str, low: float, high: float, n: int) -> str:
    """A threshold grid as a relation ``grid(q, threshold)``."""
    if kind == "percentile":
        probs = ", ".join(repr(p) for p in sweep.percentile_grid(low, high, n))
        return (f"grid AS (SELECT unnest(range({n})) AS q, unnest(quantile_cont(score, [{probs}])) AS threshold FROM ev)")
    step = f"((hi - lo) / {n - 1})"
    return (f"grid AS (SELECT i AS q, CASE WHEN i = {n - 1} THEN hi ELSE lo + i * {step} END AS threshold "
            f"FROM (SELECT lo0 + {low} * (hi0 - lo0) AS lo, hi0 - {low} * (hi0 - lo0) AS hi FROM "
            f"(SELECT min(score) AS lo0, max(score) AS hi0 FROM ev)), range({n}) AS r(i))")


def table_sql(op: str) -> str:
    """Counts and rates per grid threshold as a relation ``sw``."""
    counts = f"""cells AS (SELECT q, threshold,
  sum(CASE WHEN score {op} threshold AND label = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN score {op} threshold AND label = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN NOT score {op} threshold AND label = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN NOT score {op} threshold AND label = 1 THEN 1 ELSE 0 END) AS fn
  FROM grid, ev GROUP BY q, threshold)"""
    return f"{counts}, sw AS ({rates_sql('cells', 'q, threshold,')})"


SWEEP_DIGITS = {**RATE_DIGITS, "threshold": 6}


@query(
    "sweep_f1_linear_grid",
    f"WITH {EV}, {grid_sql('linear', 0.0, 0, 1000)}, {table_sql('>=')} SELECT * FROM sw",
    digits=SWEEP_DIGITS, ints=("q", *CELLS),
)
def sweep_f1_linear_grid(spark, folder):
    df = events(spark, folder)
    return sweep.sweep(df, sweep.linear_thresholds(df, 1000), strict=False)


@query(
    "best_f1_linear_grid",
    f"WITH {EV}, {grid_sql('linear', 0.0, 0, 1000)}, {table_sql('>=')} SELECT * FROM sw ORDER BY f1 DESC, q LIMIT 1",
    digits=SWEEP_DIGITS, ints=("q", *CELLS),
)
def best_f1_linear_grid(spark, folder):
    df = events(spark, folder)
    return sweep.best_by_f1(sweep.sweep(df, sweep.linear_thresholds(df, 1000), strict=False))


@query(
    "best_f1_percentile_grid",
    f"WITH {EV}, {grid_sql('percentile', 0, 100, 101)}, {table_sql('>')} SELECT * FROM sw ORDER BY f1 DESC, q LIMIT 1",
    digits=SWEEP_DIGITS, ints=("q", *CELLS),
)
def best_f1_percentile_grid(spark, folder):
    df = events(spark, folder)
    return sweep.best_by_f1(sweep.sweep(df, sweep.percentile_thresholds(df, 0, 100, 101)))


def under_fpr_sql(grid: str, target: float, other: str) -> str:
    return f"""WITH {EV}, {grid}, {table_sql('>')}, f AS (SELECT count(*) AS feasible FROM sw WHERE fpr <= {target}),
picked AS (SELECT * FROM (SELECT 0 AS turn, * FROM sw WHERE fpr <= {target} AND f1 > 0 ORDER BY f1 DESC, q LIMIT 1)
           UNION ALL SELECT * FROM (SELECT 1 AS turn, * FROM sw ORDER BY {other} LIMIT 1))
SELECT * EXCLUDE (turn), (SELECT feasible FROM f) AS feasible FROM picked ORDER BY turn LIMIT 1"""


@query(
    "best_f1_under_fpr_1pct",
    under_fpr_sql(grid_sql("percentile", 50, 99.9, 100), 0.01, "q DESC"),
    digits=SWEEP_DIGITS, ints=("q", *CELLS, "feasible"),
)
def best_f1_under_fpr_1pct(spark, folder):
    return sweep.best_f1_under_fpr(events(spark, folder), 0.01)


@query(
    "best_f1_under_fpr_fallback",
    under_fpr_sql(grid_sql("percentile", 80, 99.9, 50), 0.0001, "fpr, q"),
    digits=SWEEP_DIGITS, ints=("q", *CELLS, "feasible"),
)
def best_f1_under_fpr_fallback(spark, folder):
    return sweep.best_f1_under_fpr(
        events(spark, folder), 0.0001, low=80, high=99.9, n=50, fallback="min_fpr"
    )


ALPHAS_15 = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99, 1.0)
ALPHAS_11 = tuple(i / 10 for i in range(11))
ALPHAS_21 = tuple(i / 20 for i in range(21))


def alphas_sql(alphas) -> str:
    return "al(alpha_no, alpha) AS (VALUES " + ", ".join(f"({i}, CAST({a} AS DOUBLE))" for i, a in enumerate(alphas)) + ")"


MIXED = """span AS (SELECT min(score) AS l1, max(score) AS h1, min(dist) AS l2, max(dist) AS h2 FROM ev),
mx AS (SELECT alpha_no, alpha, label, alpha * ((score - l1) / (h1 - l1)) + (1.0 - alpha) * ((dist - l2) / (h2 - l2)) AS score
       FROM ev, span, al)"""


@query(
    "alpha_sweep",
    f"""WITH {EV}, {alphas_sql(ALPHAS_15)}, {MIXED},
g0 AS (SELECT alpha_no, min(score) AS lo, max(score) AS hi FROM mx GROUP BY alpha_no),
grid AS (SELECT alpha_no, i AS q, CASE WHEN i = 999 THEN hi ELSE lo + i * ((hi - lo) / 999) END AS threshold FROM g0, range(1000) AS r(i)),
c AS (SELECT alpha_no, score, sum(label) AS pos, sum(1 - label) AS neg FROM mx GROUP BY alpha_no, score),
cc AS (SELECT alpha_no, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
       sum(pos) OVER (PARTITION BY alpha_no) AS p, sum(neg) OVER (PARTITION BY alpha_no) AS n
       FROM c WINDOW w AS (PARTITION BY alpha_no ORDER BY score DESC)),
hits AS (SELECT g.alpha_no, g.q, g.threshold, x.tp, x.fp, x.n - x.fp AS tn, x.p - x.tp AS fn
         FROM grid AS g ASOF JOIN cc AS x ON g.alpha_no = x.alpha_no AND g.threshold <= x.score),
sw AS ({rates_sql('hits', 'alpha_no, q, threshold,')}),
best AS (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY alpha_no ORDER BY f1 DESC, q) = 1)
SELECT best.*, a.auroc, al.alpha FROM best
JOIN (SELECT alpha_no, sum(neg * (tp - pos / 2)) / max(p * n) AS auroc FROM cc GROUP BY alpha_no) AS a USING (alpha_no)
JOIN al USING (alpha_no)""",
    digits={**SWEEP_DIGITS, "auroc": 6, "alpha": 4}, ints=("alpha_no", "q", *CELLS),
)
def alpha_sweep(spark, folder):
    return sweep.alpha_sweep(events(spark, folder), "score", "dist", ALPHAS_15)


def best_alpha_sql(mixed: str, alphas) -> str:
    probs = ", ".join(repr(p) for p in sweep.percentile_grid(0, 100, 101))
    return f"""WITH {EV}, {alphas_sql(alphas)}, {mixed},
grid AS (SELECT DISTINCT alpha_no, threshold FROM (
  SELECT alpha_no, unnest(quantile_cont(score, [{probs}])) AS threshold FROM mx GROUP BY alpha_no)),
cells AS (SELECT g.alpha_no, g.threshold,
  sum(CASE WHEN score > threshold AND label = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN score > threshold AND label = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN NOT score > threshold AND label = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN NOT score > threshold AND label = 1 THEN 1 ELSE 0 END) AS fn
  FROM grid AS g JOIN mx USING (alpha_no) GROUP BY g.alpha_no, g.threshold),
sw AS ({rates_sql('cells', 'alpha_no, threshold,')}),
top AS (SELECT alpha_no, max(f1) AS f1 FROM sw GROUP BY alpha_no)
SELECT alpha_no, f1, CASE WHEN row_number() OVER (ORDER BY f1 DESC, alpha_no) = 1 AND f1 > 0 THEN 1 ELSE 0 END AS is_best, alpha
FROM top JOIN al USING (alpha_no)"""


@query(
    "best_alpha_batch", best_alpha_sql(MIXED, ALPHAS_21),
    digits={"f1": 6, "alpha": 4}, ints=("alpha_no", "is_best"),
)
def best_alpha_batch(spark, folder):
    df = events(spark, folder)
    span = sweep.min_max(df, "score", "dist")
    pairs = sweep.equal_pairs(
        df, sweep.scaled(F.col("score"), *span["score"]), sweep.scaled(F.col("dist"), *span["dist"])
    )
    return sweep.best_alpha(pairs, ALPHAS_21)


ONLINE = """rg AS (SELECT *, min(score) OVER w AS l1, max(score) OVER w AS h1, min(dist) OVER w AS l2, max(dist) OVER w AS h2
       FROM ev WINDOW w AS (ORDER BY us, line_id ROWS UNBOUNDED PRECEDING)),
mx AS (SELECT alpha_no, alpha, label,
       alpha * (CASE WHEN h1 - l1 < 1e-8 THEN 0 ELSE (score - l1) / (h1 - l1) END)
       + (1.0 - alpha) * (CASE WHEN h2 - l2 < 1e-8 THEN 0 ELSE (dist - l2) / (h2 - l2) END) AS score
       FROM rg, al)"""


@query(
    "best_alpha_online", best_alpha_sql(ONLINE, ALPHAS_11),
    digits={"f1": 6, "alpha": 4}, ints=("alpha_no", "is_best"),
)
def best_alpha_online(spark, folder):

    df = running(
        events(spark, folder).select("us", "line_id", "label", "score", "dist"), Order(),
        {f"{s}_{c}": (s, F.col(c)) for c in ("score", "dist") for s in ("min", "max")},
    )
    a = sweep.scaled(F.col("score"), F.col("min_score"), F.col("max_score"))
    b = sweep.scaled(F.col("dist"), F.col("min_dist"), F.col("max_dist"))
    return sweep.best_alpha(sweep.equal_pairs(df, a, b), ALPHAS_11)


@query("evt_threshold")
def evt_threshold(spark, folder):
    return evt.fit(events(spark, folder).filter("label = 0"))


@query("evt_threshold_by_kind")
def evt_threshold_by_kind(spark, folder):
    return evt.fit(events(spark, folder), keys=["kind"], quantile=0.95)


@query(
    "gpd_by_moments",
    f"""WITH {EV}, u AS (SELECT quantile_cont(score, 0.98) AS u FROM ev WHERE label = 0),
x AS (SELECT avg(score - u) AS m, var_pop(score - u) AS v, count(*) AS k, any_value(u) AS u FROM ev, u WHERE label = 0 AND score > u)
SELECT u, k, greatest(-0.5, least(0.5, 0.5 * (1 - m * m / v))) AS xi, greatest(0.5 * m * (1 + m * m / v), 1e-6) AS sigma FROM x""",
    digits={"u": 6, "xi": 6, "sigma": 4}, ints=("k",),
)
def gpd_by_moments(spark, folder):
    return evt.moments(events(spark, folder).filter("label = 0"))


