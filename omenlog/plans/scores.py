"""Ordered scores and early-warning measures over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.functions import scoring
from omenlog.operators import scores
from omenlog.operators.order import Order
from omenlog.plans.inputs import EV, events
from omenlog.plans.registry import query


def online_sql(part: str) -> str:
    return f"""rg AS (SELECT *, min(CASE WHEN d >= 0 THEN score END) OVER w AS l1, max(CASE WHEN d >= 0 THEN score END) OVER w AS h1,
  min(CASE WHEN d >= 0 THEN d END) OVER w AS l2, max(CASE WHEN d >= 0 THEN d END) OVER w AS h2
  FROM (SELECT *, dist - 10 AS d FROM ev) WINDOW w AS ({part} ORDER BY us, line_id ROWS UNBOUNDED PRECEDING))"""


ONLINE = """SELECT {keys} line_id, CASE WHEN d >= 0 THEN 0.5 * (CASE WHEN h1 - l1 < 1e-8 THEN 0 ELSE (score - l1) / (h1 - l1) END)
  + 0.5 * (CASE WHEN h2 - l2 < 1e-8 THEN 0 ELSE (d - l2) / (h2 - l2) END) ELSE score END AS hybrid FROM rg"""


def with_gate(spark, folder):
    """Events whose second score is sometimes negative, like a memory that is not ready."""
    return events(spark, folder).withColumn("d", F.col("dist") - 10)


@query("online_hybrid", f"WITH {EV}, {online_sql('')} {ONLINE.format(keys='')}", digits={"hybrid": 6})
def online_hybrid(spark, folder):
    return scores.online_hybrid(with_gate(spark, folder), "score", "d", 0.5).select("line_id", "hybrid")


@query(
    "online_hybrid_by_user", f"WITH {EV}, {online_sql('PARTITION BY key')} {ONLINE.format(keys='key,')}",
    digits={"hybrid": 6},
)
def online_hybrid_by_user(spark, folder):
    out = scores.online_hybrid(with_gate(spark, folder), "score", "d", 0.5, order=Order(("key",)))
    return out.select("key", "line_id", "hybrid")


@query(
    "batch_hybrid",
    f"""WITH {EV} SELECT line_id, 0.7 * ((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()))
  + 0.3 * ((dist - min(dist) OVER ()) / (max(dist) OVER () - min(dist) OVER ())) AS hybrid FROM ev""",
    digits={"hybrid": 6},
)
def batch_hybrid(spark, folder):
    return scores.batch_hybrid(events(spark, folder), "score", "dist", 0.7).select("line_id", "hybrid")


def change_sql(how: str, part: str = "", keys: str = "", window: int = 50) -> str:
    return f"""WITH {EV}, c AS (SELECT *, count(*) OVER w AS n, {how}(score) OVER w AS base FROM ev
  WINDOW w AS ({part} ORDER BY us, line_id ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))
SELECT {keys} line_id, CASE WHEN n < {window} THEN score ELSE greatest(0, score - base) END AS delta_score FROM c"""


@query("change_score_median", change_sql("median"), digits={"delta_score": 4})
def change_score_median(spark, folder):
    return scores.change_score(events(spark, folder)).select("line_id", "delta_score")


@query("change_score_median_long", change_sql("median", window=5000), digits={"delta_score": 4})
def change_score_median_long(spark, folder):
    return scores.change_score(events(spark, folder), window=5000).select("line_id", "delta_score")


@query("change_score_mean_by_user", change_sql("avg", "PARTITION BY key", "key,"), digits={"delta_score": 4})
def change_score_mean_by_user(spark, folder):
    out = scores.change_score(events(spark, folder), method="mean", order=Order(("key",)))
    return out.select("key", "line_id", "delta_score")


@query(
    "trend_score",
    f"""WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY us, line_id) - 1 AS pos FROM ev),
t AS (SELECT *, count(*) OVER w AS n, regr_slope(score, pos) OVER w AS slope FROM o
  WINDOW w AS (ORDER BY us, line_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT line_id, CASE WHEN n < 20 THEN score ELSE score + 0.5 * greatest(0, slope) END AS trend_score FROM t""",
    digits={"trend_score": 5},
)
def trend_score(spark, folder):
    return scores.trend_score(events(spark, folder)).select("line_id", "trend_score")


@query(
    "early_warning_penalty",
    f"""WITH {EV}, w AS (SELECT label, max(score) OVER (ORDER BY us, line_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS top FROM ev)
SELECT count(*) AS failures, avg(1 / (1 + top)) AS penalty FROM w WHERE label = 1 AND top IS NOT NULL""",
    digits={"penalty": 8},
)
def early_warning_penalty(spark, folder):
    return scores.warning_penalty(events(spark, folder))


@query(
    "score_smoothness",
    f"WITH {EV}, s AS (SELECT score - lag(score) OVER (ORDER BY us, line_id) AS d FROM ev) SELECT avg(d * d) AS smoothness FROM s",
    digits={"smoothness": 4},
)
def score_smoothness(spark, folder):
    return scores.smoothness(events(spark, folder))


@query(
    "ranking_violation",
    f"""WITH {EV}, h AS (SELECT us, line_id, label, greatest(0, 0.1 - (score - lag(score) OVER (ORDER BY us, line_id))) AS hinge,
  lag(score) OVER (ORDER BY us, line_id) AS prev FROM ev),
w AS (SELECT label, sum(CASE WHEN prev IS NOT NULL THEN hinge END) OVER f AS s, count(prev) OVER f AS n FROM h
  WINDOW f AS (ORDER BY us, line_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT sum(n) AS steps, sum(s) / sum(n) AS violation FROM w WHERE label = 1""",
    digits={"violation": 6}, ints=("steps",),
)
def ranking_violation(spark, folder):
    return scores.ranking_violation(events(spark, folder))


TTF = """t AS (SELECT *, (min(CASE WHEN label = 1 THEN us END) OVER ({part} ORDER BY us, line_id
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us) / 1e6 AS ttf FROM ev)
SELECT {keys} line_id, coalesce(ttf, -1) AS ttf, CASE WHEN ttf > 0 AND ttf <= 300 THEN 1 ELSE 0 END AS pre_failure FROM t"""


@query(
    "time_to_failure", f"WITH {EV}, {TTF.format(part='', keys='')}", digits={"ttf": 6}, ints=("pre_failure",)
)
def time_to_failure(spark, folder):
    out = scores.time_to_failure(events(spark, folder))
    return out.select("line_id", F.coalesce("ttf", F.lit(-1.0)).alias("ttf"), "pre_failure")


@query(
    "time_to_failure_by_user", f"WITH {EV}, {TTF.format(part='PARTITION BY key', keys='key,')}",
    digits={"ttf": 6}, ints=("pre_failure",),
)
def time_to_failure_by_user(spark, folder):
    out = scores.time_to_failure(events(spark, folder), keys=["key"])
    return out.select("key", "line_id", F.coalesce("ttf", F.lit(-1.0)).alias("ttf"), "pre_failure")


@query(
    "ensemble_over_k",
    f"""WITH {EV} SELECT line_id, (score + dist + score * 2) / 3 AS mean, (score * 1.0 + dist / 3 + score * 2 / 5) / (1.0 + 1.0 / 3 + 1.0 / 5) AS weighted,
  greatest(score, dist, score * 2) AS top FROM ev""",
    digits={"mean": 4, "weighted": 4, "top": 4},
)
def ensemble_over_k(spark, folder):
    parts, ks = [F.col("score"), F.col("dist"), F.col("score") * 2], [1, 3, 5]
    return events(spark, folder).select(
        "line_id",
        scoring.ensemble(parts, ks, "mean").alias("mean"),
        scoring.ensemble(parts, ks, "weighted_mean").alias("weighted"),
        scoring.ensemble(parts, ks, "max").alias("top"),
    )


@query(
    "recommendation_by_kind",
    f"""WITH {EV}, s AS (SELECT key, avg(score) / 60 AS f1, avg(dist) AS ewr, max(score) / 100 AS roi FROM ev GROUP BY key)
SELECT key, CASE WHEN f1 >= 0.9 AND ewr >= 30 AND roi >= 2 THEN 'ready' WHEN f1 >= 0.8 AND ewr >= 20 AND roi >= 1 THEN 'pilot'
  WHEN f1 >= 0.7 AND ewr >= 10 THEN 'needs improvement' ELSE 'not ready' END AS tier FROM s""",
)
def recommendation_by_kind(spark, folder):
    s = events(spark, folder).groupBy("key").agg(
        (F.avg("score") / 60).alias("f1"), F.avg("dist").alias("ewr"), (F.max("score") / 100).alias("roi")
    )
    return s.select("key", scoring.recommendation(F.col("f1"), F.col("ewr"), F.col("roi")).alias("tier"))
