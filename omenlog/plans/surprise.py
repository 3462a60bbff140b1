"""Word surprise over the document lines: train, score, pool and the whole path to a report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from omenlog.operators import classify, line_scores, surprise
from omenlog.plans.inputs import LN, table
from omenlog.plans.registry import query
from omenlog.plans.text import NORM, normal_lines
from omenlog.session import checkpointed, compact, passing

LABELLED = f"""WITH {LN}, {NORM}, lb AS (SELECT nm.*, coalesce(toxic, 0) AS label FROM nm LEFT JOIN labels ON doc_id = owner)"""


def labelled_lines(spark, folder, write=compact):
    """Templates with the label of their document, normal where it is not labelled; ``write`` writes the table."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("owner"), F.col("toxic").alias("label"))
    known = normal_lines(spark, folder).join(labels, "owner", "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )
    # Read several times below (training, scoring, lookup): the templates are written once.
    return write(known.select("line_id", "owner", "source", "norm", "label"))


def model_sql(unit: str = "string_split(norm, ' ')") -> str:
    """Training counts and the surprise of every word of every distinct line: relation ``sc``."""
    return f"""{LABELLED},
tw AS (SELECT {unit} AS w FROM lb WHERE label = 0),
tp AS (SELECT w, unnest(range(len(w))) AS i FROM tw),
tr AS (SELECT w[i + 1] AS word, coalesce(w[i], '<s>') AS l, coalesce(w[i + 2], '</s>') AS r FROM tp),
c3 AS (SELECT l, r, word, count(*) AS c FROM tr GROUP BY ALL), x3 AS (SELECT l, r, sum(c) AS n, max(c) AS m FROM c3 GROUP BY l, r),
c2 AS (SELECT l, word, sum(c) AS c FROM c3 GROUP BY ALL), x2 AS (SELECT l, sum(c) AS n, max(c) AS m FROM c2 GROUP BY l),
c1 AS (SELECT word, sum(c) AS c FROM c2 GROUP BY ALL), x1 AS (SELECT sum(c) AS n, max(c) AS m, count(*) AS v FROM c1),
dw AS (SELECT norm, {unit} AS w FROM (SELECT DISTINCT norm FROM lb)),
dp AS (SELECT norm, w, unnest(range(len(w))) AS i FROM dw),
ps AS (SELECT norm, i AS pos, w[i + 1] AS word, coalesce(w[i], '<s>') AS l, coalesce(w[i + 2], '</s>') AS r FROM dp),
jn AS (SELECT ps.*, c3.c AS k3, x3.n AS n3, x3.m AS m3, c2.c AS k2, x2.n AS n2, x2.m AS m2, c1.c AS k1, x1.n AS n1, x1.m AS m1, 0.1 * (x1.v + 1) AS room
  FROM ps LEFT JOIN c3 USING (l, r, word) LEFT JOIN x3 USING (l, r) LEFT JOIN c2 USING (l, word) LEFT JOIN x2 USING (l) LEFT JOIN c1 USING (word) CROSS JOIN x1),
sc AS (SELECT norm, pos, word,
  -ln(CASE WHEN n3 IS NOT NULL THEN (coalesce(k3, 0) + 0.1) / (n3 + room) WHEN n2 IS NOT NULL THEN (coalesce(k2, 0) + 0.1) / (n2 + room) ELSE (coalesce(k1, 0) + 0.1) / (n1 + room) END) AS err,
  1 - CASE WHEN n3 IS NOT NULL THEN (m3 + 0.1) / (n3 + room) WHEN n2 IS NOT NULL THEN (m2 + 0.1) / (n2 + room) ELSE (m1 + 0.1) / (n1 + room) END AS prob FROM jn)"""


def scored_words(spark, folder, unit="word"):
    with passing(spark) as step:
        model, lines = surprise.trained(labelled_lines(spark, folder, step), F.col("label") == 0, unit=unit)
    named = lines.withColumn("line", F.md5("norm"))
    return surprise.word_scores(model, named, keep=["line"]).select("line", "pos", "word", "err", "prob")


def scored_lines(spark, folder):
    """Labelled lines with the number of their text, and the word signals of the texts; no text is kept."""
    with passing(spark) as step:
        with passing(spark) as first:
            df = labelled_lines(spark, folder, first)
            model, lines = surprise.trained(df, F.col("label") == 0, write=step)
            every = compact(surprise.to_lines(df.select("line_id", "label", "norm"), lines).drop("norm"))
        return every, surprise.line_signals(model, lines)


@query(
    "word_surprise",
    f"{model_sql()} SELECT md5(norm) AS line, pos, word, err, prob FROM sc",
    digits={"err": 6, "prob": 6}, ints=("pos",),
)
def word_surprise(spark, folder):
    return scored_words(spark, folder)


@query(
    "piece_surprise",
    model_sql("regexp_extract_all(norm, '[A-Za-z]+|[0-9]+')") + " SELECT md5(norm) AS line, pos, word, err, prob FROM sc",
    digits={"err": 6, "prob": 6}, ints=("pos",),
)
def piece_surprise(spark, folder):
    return scored_words(spark, folder, "piece")


ADAPTIVE = ("error_mean", "error_pctl99", "prob_mean", "prob_pctl99")
LINE_SQL = """ls AS (SELECT norm, avg(err) AS error_mean, quantile_cont(err, 0.99) AS error_pctl99, avg(prob) AS prob_mean,
  quantile_cont(prob, 0.99) AS prob_pctl99 FROM sc GROUP BY norm)"""


@query(
    "line_surprise",
    f"{model_sql()}, {LINE_SQL} SELECT line_id, label, {', '.join(ADAPTIVE)} FROM lb JOIN ls USING (norm)",
    digits={c: 6 for c in ADAPTIVE}, ints=("label",),
)
def line_surprise(spark, folder):
    every, signals = scored_lines(spark, folder)
    return every.join(surprise.adaptive_scores(signals, ["line_no"]), "line_no").drop("line_no")


@query(
    "line_surprise_top_k",
    f"""{model_sql()}, q AS (SELECT norm, err, prob, row_number() OVER (PARTITION BY norm ORDER BY err DESC) AS e,
  row_number() OVER (PARTITION BY norm ORDER BY prob) AS lo, row_number() OVER (PARTITION BY norm ORDER BY prob DESC) AS hi FROM sc),
t AS (SELECT norm, k, avg(CASE WHEN e <= k THEN err END) AS error, avg(CASE WHEN lo <= k THEN prob END) AS prob, avg(CASE WHEN hi <= k THEN prob END) AS probtopk
  FROM q, (VALUES (1), (3), (5), (10)) AS v(k) GROUP BY norm, k)
SELECT line_id, k, error, prob, probtopk FROM lb JOIN t USING (norm)""",
    digits={"error": 6, "prob": 6, "probtopk": 6}, ints=("k",),
)
def line_surprise_top_k(spark, folder):
    every, signals = scored_lines(spark, folder)
    once = signals.select("line_no", surprise.top_k_families().alias("s"))
    return every.join(once, "line_no").select("line_id", F.explode("s").alias("s")).select("line_id", "s.*")


@query(
    "surprise_quality",
    f"""{model_sql()}, {LINE_SQL}, al AS (SELECT label, error_mean AS score FROM lb JOIN ls USING (norm)),
c AS (SELECT round(score, 9) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM al GROUP BY 1),
u AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)
SELECT sum(neg * (tp - pos / 2)) / max(p * n) AS auroc FROM u""",
    digits={"auroc": 6},
)
def surprise_quality(spark, folder):
    every, signals = scored_lines(spark, folder)
    once = surprise.adaptive_scores(signals, ["line_no"]).select("line_no", F.round("error_mean", 9).alias("score"))
    # the curve reads its rows more than once
    return classify.auroc(checkpointed(every.join(once, "line_no").select("label", "score")))


@query(
    "surprise_quality_by_k",
    f"""{model_sql()}, q AS (SELECT norm, err, prob, row_number() OVER (PARTITION BY norm ORDER BY err DESC) AS e,
  row_number() OVER (PARTITION BY norm ORDER BY prob) AS lo, row_number() OVER (PARTITION BY norm ORDER BY prob DESC) AS hi FROM sc),
t AS (SELECT norm, k, avg(CASE WHEN e <= k THEN err END) AS error, avg(CASE WHEN lo <= k THEN prob END) AS prob, avg(CASE WHEN hi <= k THEN prob END) AS probtopk
  FROM q, (VALUES (1), (3), (5), (10)) AS v(k) GROUP BY norm, k),
f AS (SELECT norm, k, unnest(['error', 'prob', 'probtopk']) AS family, unnest([error, prob, probtopk]) AS score FROM t),
c AS (SELECT family, k, round(score, 6) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM lb JOIN f USING (norm) GROUP BY ALL),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY family, k) AS p, sum(neg) OVER (PARTITION BY family, k) AS n
  FROM c WINDOW w AS (PARTITION BY family, k ORDER BY score DESC))
SELECT family, k, sum(neg * (tp - pos / 2)) / max(p * n) AS auroc, max(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-12)) AS best_f1
FROM u GROUP BY family, k""",
    digits={"auroc": 5, "best_f1": 5}, ints=("k",),
)
def surprise_quality_by_k(spark, folder):
    """How well each score family tells failures apart, for every k."""
    every, signals = scored_lines(spark, folder)
    families = ("error", "prob", "probtopk")
    cells = F.array(*[F.struct(F.lit(n).alias("family"), F.round(n, 6).alias("score")) for n in families])
    once = signals.select("line_no", surprise.top_k_families().alias("s"))
    by_k = every.join(once, "line_no").select("label", F.explode("s").alias("s")).select("label", "s.*")
    rows = checkpointed(by_k.select("label", "k", F.explode(cells).alias("c")).select("label", "k", "c.*"))
    by = ["family", "k"]
    steps = classify.curve(rows, by=by)
    return classify.auroc(rows, by=by, steps=steps).join(classify.best_f1(rows, by=by, steps=steps).select(*by, "best_f1"), by)


def letter_model(batches):
    """A stand-in for a model of the user's own: share of vowels as surprise."""
    for pdf in batches:
        n = pdf["norm"].str.len().clip(lower=1)
        yield pd.DataFrame({"norm": pdf["norm"], "own_score": 1 - pdf["norm"].str.count("[aeiou]") / n})


@query(
    "own_model_scores",
    f"""WITH {LN}, {NORM} SELECT line_id, 1 - len(regexp_extract_all(norm, '[aeiou]')) / length(norm) AS own_score FROM nm""",
    digits={"own_score": 6},
)
def own_model_scores(spark, folder):
    out = surprise.with_model(normal_lines(spark, folder), letter_model, "norm string, own_score double")
    return out.select("line_id", "own_score")


@query("line_embeddings")
def line_embeddings(spark, folder):
    df = checkpointed(normal_lines(spark, folder).select("line_id", "norm"))
    return df.select("line_id", "norm").join(line_scores.line_vectors(df), "norm").select("line_id", "vec")


def timed_lines(spark, folder, write=compact):
    """Labelled templates; documents carry no time, their lines are a second apart.

    Line ids leave no room for microseconds in a long, so the times are decimals.
    """
    return labelled_lines(spark, folder, write).withColumn("us", F.col("line_id").cast("decimal(20,0)") * 1_000_000)


def full_scores(spark, folder, memory, **switches):
    """``score_lines`` by the model of the normal lines; the texts and the model go before the order is scanned."""
    with passing(spark) as step:
        df = timed_lines(spark, folder, step)
        model, lines = surprise.trained(df, F.col("label") == 0, write=step)
        out = line_scores.score_texts(df, model, memory=memory, keep=["label"], lines=lines)
    return line_scores.score_order(out, memory=memory, **switches)


@query("full_line_scoring")
def full_line_scoring(spark, folder):
    """Raw lines to the hybrid score: parse, distinct lines, surprise, memory distance, blend."""
    out = full_scores(spark, folder, time=True, memory=True)
    return out.select("line_id", "label", "mlm_error", "mlm_prob", "log_delta", "knn_distance", "hybrid")


@query(
    "baseline_line_scoring",
    f"""{model_sql()}, {LINE_SQL} SELECT line_id, label, error_mean AS mlm_error, prob_mean AS mlm_prob FROM lb JOIN ls USING (norm)""",
    digits={"mlm_error": 6, "mlm_prob": 6}, ints=("label",),
)
def baseline_line_scoring(spark, folder):
    out = full_scores(spark, folder, memory=False)
    return out.select("line_id", "label", "mlm_error", "mlm_prob")
