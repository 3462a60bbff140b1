"""Context-memory distances, moments and class separation over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.functions import scoring
from omenlog.operators import context, reference, scores
from omenlog.operators.order import Order
from omenlog.plans.inputs import EV, events, vectors
from omenlog.plans.registry import query

XS = """x AS (SELECT vec_id AS line_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings)"""


def cosine_sql(part: str, join: str, order: str) -> str:
    return f"""WITH {XS}, w AS (SELECT line_id, label, d, v, avg(v) OVER f AS m, count(*) OVER f AS n FROM x
  WINDOW f AS (PARTITION BY {part} d ORDER BY line_id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING))
SELECT {join} line_id, CASE WHEN max(n) < 10 THEN -1 ELSE 1 - sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) END AS distance
FROM w GROUP BY {order} line_id"""


@query("memory_cosine", cosine_sql("", "", ""), digits={"distance": 6})
def memory_cosine(spark, folder):
    return context.cosine(vectors(spark, folder), not_ready=-1.0)


@query("memory_cosine_by_session", cosine_sql("label,", "label,", "label,"), digits={"distance": 6}, ints=("label",))
def memory_cosine_by_session(spark, folder):
    return context.cosine(vectors(spark, folder), order=Order(("label",)), not_ready=-1.0)


def knn_sql(final: str) -> str:
    return f"""WITH o AS (SELECT vec_id AS line_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
p AS (SELECT a.line_id, a.i, list_distance(a.e, b.e) AS dist FROM o AS a JOIN o AS b ON b.i BETWEEN a.i - 128 AND a.i - 1),
r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dist) AS rk FROM p),
n AS (SELECT line_id, {final} AS distance FROM r WHERE rk <= 10 GROUP BY line_id HAVING count(*) = 10)
SELECT line_id, coalesce(distance, -1) AS distance FROM o LEFT JOIN n USING (line_id)"""


for how, final in (
    ("mean", "avg(dist)"), ("max", "max(dist)"), ("median", "median(dist)"),
    ("harmonic", "10 / sum(1 / (dist + 1e-10))"),
):
    def _knn(spark, folder, how=how):
        return context.knn(vectors(spark, folder), k=10, aggregate=how, not_ready=-1.0)

    query(f"memory_knn_{how}", knn_sql(final), digits={"distance": 6})(_knn)


@query("memory_knn_reduced")
def memory_knn_reduced(spark, folder):
    return context.knn(vectors(spark, folder), k=10, pca=16, not_ready=-1.0)


@query("memory_mahalanobis")
def memory_mahalanobis(spark, folder):
    return context.mahalanobis(vectors(spark, folder), not_ready=0.0)


@query("memory_mahalanobis_by_session")
def memory_mahalanobis_by_session(spark, folder):
    return context.mahalanobis(vectors(spark, folder), capacity=32, order=Order(("label",)))


@query(
    "memory_statistics",
    f"""WITH {XS}, w AS (SELECT line_id, d, avg(v) OVER f AS m, count(*) OVER f AS n, var_samp(v) OVER f AS s FROM x
  WINDOW f AS (PARTITION BY d ORDER BY line_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))
SELECT line_id, max(n) AS n, coalesce(max(CASE WHEN d = 0 THEN m END), 0) AS first_mean, coalesce(sum(m), 0) AS sum_mean,
  coalesce(sum(s), 0) AS total_variance FROM w GROUP BY line_id""",
    digits={"first_mean": 6, "sum_mean": 6, "total_variance": 6},
)
def memory_statistics(spark, folder):
    out = context.memory_statistics(vectors(spark, folder), capacity=64)
    zero = F.lit(0.0)
    return out.select(
        "line_id", "n", F.coalesce(F.get("mean", F.lit(0)), zero).alias("first_mean"),
        F.coalesce(scoring.array_sum(F.col("mean")), zero).alias("sum_mean"),
        F.coalesce(F.when(~F.isnan("total_variance"), F.col("total_variance")), zero).alias("total_variance"),
    )


@query(
    "vector_means",
    f"WITH {XS} SELECT d AS i, avg(v) AS mean FROM x GROUP BY d",
    digits={"mean": 6}, ints=("i",),
)
def vector_means(spark, folder):
    return reference.mean_vector(vectors(spark, folder)).select(F.posexplode("mean").alias("i", "mean"))


@query(
    "vector_covariance",
    f"WITH {XS} SELECT a.d AS i, b.d AS j, covar_samp(a.v, b.v) AS cov FROM x AS a JOIN x AS b USING (line_id) GROUP BY 1, 2",
    digits={"cov": 8}, ints=("i", "j"),
)
def vector_covariance(spark, folder):
    return reference.covariance(vectors(spark, folder))


def two_classes(spark, folder):
    return vectors(spark, folder).withColumn("label", (F.col("label") != 0).cast("int"))


@query(
    "class_separation",
    f"""WITH {XS}, y AS (SELECT line_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS c, d, v FROM x), m AS (SELECT c, d, avg(v) AS m FROM y GROUP BY c, d),
s AS (SELECT c, avg(dist) AS spread FROM (SELECT y.c, line_id, sqrt(sum((v - m) * (v - m))) AS dist FROM y JOIN m USING (c, d) GROUP BY y.c, line_id) GROUP BY c),
t AS (SELECT sqrt(sum((a.m - b.m) * (a.m - b.m))) AS inter FROM m AS a JOIN m AS b USING (d) WHERE a.c = 0 AND b.c = 1)
SELECT inter, s0.spread AS intra_normal, s1.spread AS intra_anomaly, inter / (s0.spread + s1.spread + 1e-8) AS ratio
FROM t, (SELECT spread FROM s WHERE c = 0) AS s0, (SELECT spread FROM s WHERE c = 1) AS s1""",
    digits={"inter": 6, "intra_normal": 6, "intra_anomaly": 6, "ratio": 6},
)
def class_separation(spark, folder):
    return reference.separation(two_classes(spark, folder))


@query(
    "drift_before_failure",
    f"""WITH {EV}, {XS}, t AS (SELECT line_id, label, (min(CASE WHEN label = 1 THEN us END) OVER (ORDER BY us, line_id
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us) / 1e6 AS ttf FROM ev),
j AS (SELECT x.line_id, d, v, t.label, ttf FROM x JOIN t USING (line_id)), c AS (SELECT d, avg(v) AS m FROM j WHERE label = 0 GROUP BY d),
q AS (SELECT line_id, sqrt(sum((v - m) * (v - m))) AS dist FROM j JOIN c USING (d) WHERE ttf > 0 AND ttf <= 300 GROUP BY line_id)
SELECT count(*) AS rows, avg(dist) AS drift FROM q""",
    digits={"drift": 6},
)
def drift_before_failure(spark, folder):
    flagged = scores.time_to_failure(events(spark, folder)).select("line_id", "label", "pre_failure")
    return reference.drift_before_failure(vectors(spark, folder).drop("label").join(flagged, "line_id"))


@query(
    "early_failure_similarity_margin",
    f"""WITH {EV}, o AS (SELECT vec_id AS line_id, embedding::DOUBLE[] AS e, label, row_number() OVER (ORDER BY vec_id) AS i
  FROM (SELECT vec_id, embedding, ev.label FROM embeddings JOIN ev ON ev.line_id = vec_id)),
d AS (SELECT e FROM o WHERE label = 0 ORDER BY md5(CAST(line_id AS VARCHAR)), line_id LIMIT 10),
n AS (SELECT o.i, avg(list_inner_product(o.e, d.e)) AS near FROM o, d GROUP BY o.i),
p AS (SELECT f.line_id, greatest(0, 0.5 - list_cosine_similarity(b.e, f.e) + near) AS loss FROM o f JOIN o b ON b.i BETWEEN f.i - 50 AND f.i - 1
  JOIN n ON n.i = b.i WHERE f.label = 1), m AS (SELECT line_id, avg(loss) AS m FROM p GROUP BY line_id)
SELECT count(*) AS failures, coalesce(avg(m), 0) AS margin FROM m""",
    digits={"margin": 6},
)
def early_failure_similarity_margin(spark, folder):
    labels = events(spark, folder).select("line_id", "label")
    return context.similarity_margin(vectors(spark, folder).drop("label").join(labels, "line_id"))


def distances(spark, folder, **options):
    df = two_classes(spark, folder)
    fitted = reference.fit(df.filter("label = 1"), **options)
    return df.select("line_id", "label", fitted.distance("vec").alias("distance"))


@query("reference_mahalanobis_oas")
def reference_mahalanobis_oas(spark, folder):
    return distances(spark, folder, components=32, estimator="oas")


@query("reference_mahalanobis_ledoit_wolf")
def reference_mahalanobis_ledoit_wolf(spark, folder):
    return distances(spark, folder, components=None, estimator="ledoit_wolf")


@query("memory_slot_mahalanobis")
def memory_slot_mahalanobis(spark, folder):
    return distances(spark, folder, components=None, estimator="ridge")


@query(
    "soft_memory_retrieval",
    f"""WITH {XS}, m AS (SELECT label AS slot, d, avg(v) AS m FROM x GROUP BY 1, 2),
l AS (SELECT x.line_id, slot, sum(v * m) / 8.0 AS z FROM x JOIN m USING (d) GROUP BY 1, 2),
w AS (SELECT line_id, slot, exp(z) / sum(exp(z)) OVER (PARTITION BY line_id) AS w FROM l),
r AS (SELECT line_id, d, sum(w * m) AS r FROM w JOIN m USING (slot) GROUP BY 1, 2)
SELECT line_id, (SELECT max(w) FROM w WHERE w.line_id = r.line_id) AS top_weight, sum(r) AS sum_retrieved FROM r GROUP BY line_id""",
    digits={"top_weight": 6, "sum_retrieved": 6},
)
def soft_memory_retrieval(spark, folder):
    df = vectors(spark, folder)
    memory = reference.mean_vector(df, by=("label",)).withColumnRenamed("label", "slot")
    out = reference.soft_retrieval(df, memory)
    return out.select(
        "line_id", F.array_max("weights").alias("top_weight"),
        scoring.array_sum(F.col("retrieved")).alias("sum_retrieved"),
    )


@query(
    "confidence_weighted_score",
    f"""WITH {XS}, e AS (SELECT line_id, v, exp(v) / sum(exp(v)) OVER (PARTITION BY line_id) AS p FROM x),
a AS (SELECT line_id, 0.95 - (-sum(p * ln(p + 1e-10))) / ln(64) * (0.95 - 0.5) AS alpha, max(v) AS s, -min(v) AS m FROM e GROUP BY line_id)
SELECT line_id, alpha, alpha * s + (1 - alpha) * m AS score FROM a""",
    digits={"alpha": 6, "score": 6},
)
def confidence_weighted_score(spark, folder):
    df = vectors(spark, folder).withColumn("v", F.col("vec").cast("array<double>"))
    out = df.withColumn("alpha", scoring.confidence_alpha(scoring.softmax(F.col("v"))))
    a = F.col("alpha")
    return out.select(
        "line_id", "alpha", (a * F.array_max("v") + (1 - a) * -F.array_min("v")).alias("score")
    )


POOLED = """q AS (SELECT line_id, abs(v) AS v, row_number() OVER (PARTITION BY line_id ORDER BY abs(v) DESC) AS hi,
  row_number() OVER (PARTITION BY line_id ORDER BY abs(v)) AS lo FROM x)"""


@query(
    "pooled_positions",
    f"""WITH {XS}, {POOLED} SELECT line_id, avg(v) AS mean, max(v) AS max, avg(CASE WHEN hi <= 5 THEN v END) AS topk_mean,
  avg(CASE WHEN lo <= 5 THEN v END) AS bottomk_mean, quantile_cont(v, 0.99) AS pctl FROM q GROUP BY line_id""",
    digits={m: 6 for m in scoring.POOLING},
)
def pooled_positions(spark, folder):
    values = F.transform(F.col("vec").cast("array<double>"), F.abs)
    df = vectors(spark, folder).select("line_id", values.alias("a"))
    return df.select("line_id", *[
        scoring.pool(F.col("a"), m, 99 if m == "pctl" else 5).alias(m) for m in scoring.POOLING
    ])


@query(
    "top_k_sweep",
    f"""WITH {XS}, {POOLED}, k(k) AS (VALUES (1), (3), (5), (10)) SELECT line_id, k, avg(CASE WHEN hi <= k THEN v END) AS error,
  avg(CASE WHEN lo <= k THEN v END) AS prob, avg(CASE WHEN hi <= k THEN v END) AS probtopk FROM q, k GROUP BY line_id, k""",
    digits={"error": 6, "prob": 6, "probtopk": 6}, ints=("k",),
)
def top_k_sweep(spark, folder):
    from omenlog.operators import surprise

    values = F.transform(F.col("vec").cast("array<double>"), F.abs)
    arrays = vectors(spark, folder).select("line_id", values.alias("errors"), values.alias("probs"))
    return surprise.top_k_scores(arrays, keep=["line_id"])
