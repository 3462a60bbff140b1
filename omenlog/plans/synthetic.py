"""Synthetic anomalies from the document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.functions.words import words
from omenlog.operators import surprise, synthetic
from omenlog.operators.order import Order, running
from omenlog.plans.inputs import EV, LN, events
from omenlog.plans.registry import query
from omenlog.plans.text import NORM, WORDS, normal_lines
from omenlog.session import checkpointed


def draw_sql(purpose: str, *of: str, seed: int = 42) -> str:
    """The same draw as ``synthetic.draw``."""
    name = " || '|' || ".join([f"'{seed}|{purpose}'", *[f"CAST({c} AS VARCHAR)" for c in of]])
    return f"CAST('0x' || substr(md5({name}), 1, 15) AS BIGINT)"


def share_sql(low: float, high: float, purpose: str, *of: str) -> str:
    return f"({low} + ({draw_sql(purpose, *of)} % 1073741824) / 1073741824.0 * {high - low})"


def augment_sql(ratio: float, method: str, result: str) -> str:
    """Synthetic lines as relation ``made(line_id, sample, method, text)``; ``method`` as SQL over ``sample``."""
    return f"""WITH {LN}, {NORM}, tk AS (SELECT line_id, string_split(norm, ' ') AS w, row_number() OVER (ORDER BY line_id) - 1 AS pos FROM nm),
n AS (SELECT count(*) AS n FROM tk), vo AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i, count(*) OVER () AS many
  FROM (SELECT DISTINCT unnest(w) AS word FROM tk)),
dr AS (SELECT sample, {draw_sql("row", "sample")} % n AS pos, {draw_sql("other", "sample")} % n AS pos2, {method} AS method
  FROM n, (SELECT unnest(range(CAST(floor(n * {ratio}) AS BIGINT))) AS sample FROM n)),
pk AS (SELECT dr.sample, dr.method, a.line_id, a.w, b.w AS w2 FROM dr JOIN tk a ON a.pos = dr.pos JOIN tk b ON b.pos = dr.pos2),
ps AS (SELECT sample, method, w, unnest(w) AS token, unnest(range(len(w))) AS pos FROM pk),
pl AS (SELECT sample, pos, row_number() OVER (PARTITION BY sample ORDER BY {draw_sql("place", "sample", "pos")}, pos) AS k,
  1 + {draw_sql("count", "sample")} % least(3, greatest(len(w), 1)) AS most FROM ps WHERE method = 'replace'),
rp AS (SELECT sample, pos, word FROM pl JOIN vo ON i = {draw_sql("word", "sample", "pos")} % many WHERE k <= most),
tx AS (SELECT ps.sample, string_agg(coalesce(rp.word, token), ' ' ORDER BY ps.pos) AS replaced,
  string_agg(token, ' ' ORDER BY {draw_sql("shuffle", "ps.sample", "ps.pos")}, token) AS shuffled
  FROM ps LEFT JOIN rp ON ps.sample = rp.sample AND ps.pos = rp.pos GROUP BY ps.sample),
mx AS (SELECT sample, least(len(w), len(w2)) AS m, least(len(w) // 2, len(w), len(w2)) AS k FROM pk),
made AS (SELECT line_id, sample, method, CASE method WHEN 'replace' THEN replaced WHEN 'shuffle' THEN shuffled
  WHEN 'mix' THEN array_to_string(list_concat(w[1:k], w2[k + 1:m]), ' ') ELSE array_to_string(w, ' ') END AS text
  FROM pk JOIN tx USING (sample) JOIN mx USING (sample))
{result}"""


def token_lines(spark, folder):
    return normal_lines(spark, folder).select("line_id", words(F.col("norm")).alias("tokens"))


def lines_and_vocabulary(spark, folder):
    """The words of every line and the distinct words; the templates of both are written once."""
    df = checkpointed(normal_lines(spark, folder).select("line_id", "norm"))
    return df.select("line_id", words(F.col("norm")).alias("tokens")), surprise.word_counts(df).select("word")


@query(
    "augmented_line_counts",
    f"""WITH {LN}, {NORM}, n AS (SELECT count(*) AS n FROM nm) SELECT 0 AS label, n AS lines FROM n
UNION ALL SELECT 1, CAST(floor(n * 0.1) AS BIGINT) FROM n""",
    ints=("label", "lines"),
)
def augmented_line_counts(spark, folder):
    out = synthetic.augment(*lines_and_vocabulary(spark, folder), ratio=0.1)
    return out.groupBy("label").agg(F.count("*").alias("lines"))


@query(
    "augmented_lines",
    augment_sql(0.2, f"['replace', 'shuffle', 'temporal', 'mix'][{draw_sql('method', 'sample')} % 4 + 1]", """SELECT line_id, sample, method, text, 1 AS label FROM made
UNION ALL SELECT line_id, -1, 'original', array_to_string(w, ' '), 0 FROM tk"""),
    ints=("label",), nulls={"sample": -1},
)
def augmented_lines(spark, folder):
    out = synthetic.augment(*lines_and_vocabulary(spark, folder), ratio=0.2)
    return out.select("line_id", "sample", "method", F.array_join("tokens", " ").alias("text"), "label")


@query("augmented_by_replacement", augment_sql(0.1, "'replace'", "SELECT line_id, sample, text FROM made"))
def augmented_by_replacement(spark, folder):
    out = synthetic.augment(*lines_and_vocabulary(spark, folder), methods=["replace"])
    return out.filter("label = 1").select("line_id", "sample", F.array_join("tokens", " ").alias("text"))


@query(
    "shuffled_lines",
    f"""WITH {LN}, {NORM}, p AS (SELECT line_id, unnest(string_split(norm, ' ')) AS token, unnest(range(len(string_split(norm, ' ')))) AS pos FROM nm)
SELECT line_id, string_agg(token, ' ' ORDER BY {draw_sql("shuffle", "line_id", "pos")}, token) AS text FROM p GROUP BY line_id""",
)
def shuffled_lines(spark, folder):
    out = token_lines(spark, folder).withColumn("tokens", synthetic.shuffled(F.col("tokens"), F.col("line_id")))
    return out.select("line_id", F.array_join("tokens", " ").alias("text"))


@query(
    "mixed_neighbour_lines",
    f"""WITH {LN}, {NORM}, a AS (SELECT line_id, string_split(norm, ' ') AS a, string_split(lag(norm) OVER (ORDER BY line_id), ' ') AS b FROM nm),
c AS (SELECT line_id, a, b, least(len(a), len(b)) AS m, least(len(a) // 2, least(len(a), len(b))) AS k FROM a WHERE b IS NOT NULL)
SELECT line_id, array_to_string(list_concat(a[1:k], b[k + 1:m]), ' ') AS text FROM c""",
)
def mixed_neighbour_lines(spark, folder):
    df = running(
        token_lines(spark, folder), Order((), ("line_id",)), {"before": ("last", F.col("tokens"))}, exclusive=True
    ).filter("before is not null")
    both = synthetic.mixed(F.col("tokens"), F.col("before"))
    return df.select("line_id", F.array_join(both, " ").alias("text"))


@query(
    "burst_time_deltas",
    f"""WITH {EV} SELECT line_id, coalesce((us - lag(us) OVER (ORDER BY us, line_id)) / 1000, 0) * 0.001 AS burst FROM ev""",
    digits={"burst": 6},
)
def burst_time_deltas(spark, folder):
    from omenlog.operators.temporal import gap_seconds

    df = gap_seconds(events(spark, folder)).withColumn("ms", F.coalesce(F.col("delta_t"), F.lit(0.0)) * 1000)
    return df.select("line_id", synthetic.distorted(F.col("ms"), F.col("line_id"), "burst").alias("burst"))


@query(
    "distorted_time_deltas",
    f"""WITH {EV}, d AS (SELECT line_id, coalesce((us - lag(us) OVER (ORDER BY us, line_id)) / 1000, 0) AS ms FROM ev)
SELECT line_id, ms, ms * {share_sql(10, 100, "gap", "line_id")} AS large_gap, ms * {share_sql(0.01, 0.1, "gap", "line_id")} AS small_gap FROM d""",
    digits={"ms": 3, "large_gap": 3, "small_gap": 4},
)
def distorted_time_deltas(spark, folder):
    from omenlog.operators.temporal import gap_seconds

    df = gap_seconds(events(spark, folder)).withColumn("ms", F.coalesce(F.col("delta_t"), F.lit(0.0)) * 1000)
    return df.select("line_id", "ms", *[
        synthetic.distorted(F.col("ms"), F.col("line_id"), k).alias(k) for k in ("large_gap", "small_gap")
    ])


@query(
    "mixed_templates",
    f"""WITH {LN}, {NORM}, t AS (SELECT norm, row_number() OVER (ORDER BY norm) - 1 AS t, count(*) OVER () AS many
  FROM (SELECT norm FROM nm GROUP BY norm HAVING count(*) >= 2)),
m AS (SELECT max(many) AS many FROM t), d AS (SELECT sample, many, {draw_sql("first", "sample")} % many AS t1 FROM m, (SELECT unnest(range(1000)) AS sample)),
e AS (SELECT sample, t1, (t1 + 1 + {draw_sql("second", "sample")} % (many - 1)) % many AS t2 FROM d),
j AS (SELECT sample, string_split(a.norm, ' ') AS a, string_split(b.norm, ' ') AS b FROM e JOIN t a ON a.t = t1 JOIN t b ON b.t = t2)
SELECT sample, array_to_string(list_concat(a[1:len(a) // 2], b[len(a) // 2 + 1:]), ' ') AS text FROM j""",
)
def mixed_templates(spark, folder):
    found = surprise.templates(normal_lines(spark, folder), min_frequency=2)
    out = synthetic.mix_templates(found, 1000)
    return out.select("sample", F.array_join("tokens", " ").alias("text"))


@query(
    "rare_word_insertions",
    f"""WITH {LN}, {NORM}, {WORDS}, r AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS r, count(*) OVER () AS many
  FROM wc WHERE n <= (SELECT quantile_cont(n, 0.1) FROM wc)),
a AS (SELECT line_id, string_split(norm, ' ') AS w FROM nm),
b AS (SELECT line_id, list_concat(list_append(w[1:k], word), w[k + 1:]) AS w FROM (
  SELECT line_id, w, word, {draw_sql("at", "line_id")} % (len(w) + 1) AS k FROM a JOIN r ON r = {draw_sql("rare", "line_id")} % many)),
c AS (SELECT line_id, list_concat(list_append(w[1:k], word), w[k + 1:]) AS w FROM (
  SELECT line_id, w, word, {draw_sql("at", "line_id", seed=43)} % (len(w) + 1) AS k FROM b JOIN r ON r = {draw_sql("rare", "line_id", seed=43)} % many))
SELECT line_id, array_to_string(w, ' ') AS text FROM c""",
)
def rare_word_insertions(spark, folder):
    df = checkpointed(normal_lines(spark, folder).select("line_id", "norm"))
    lines = df.select("line_id", words(F.col("norm")).alias("tokens"))
    out = synthetic.insert_rare(lines, surprise.rare_words(df), insertions=2)
    return out.select("line_id", F.array_join("tokens", " ").alias("text"))
