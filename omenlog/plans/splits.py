"""Chronological splits, block grouping and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from omenlog.operators import split
from omenlog.operators.order import Order, ordinal
from omenlog.plans.inputs import EV, LN, events, lines, table
from omenlog.plans.registry import query

ORDINAL = "o AS (SELECT *, row_number() OVER (ORDER BY us, line_id) - 1 AS pos, count(*) OVER () AS n FROM ev)"


def three_way_sql(first: str, second: str) -> str:
    return f"""WITH {EV}, {ORDINAL} SELECT line_id, CASE WHEN pos < {first} THEN 'train' WHEN pos < {second} THEN 'val' ELSE 'test' END AS part FROM o"""


@query("chronological_split", three_way_sql("floor(n * 0.7)", f"floor(n * {0.7 + 0.1!r})"))
def chronological_split(spark, folder):
    return split.chronological(events(spark, folder)).select("line_id", "part")


@query("chronological_split_by_parts", three_way_sql("floor(n * 0.5)", "floor(n * 0.5) + floor(n * 0.25)"))
def chronological_split_by_parts(spark, folder):
    return split.chronological(events(spark, folder), (0.5, 0.25, 0.25), cut_rule="parts").select("line_id", "part")


@query("chronological_order", f"WITH {EV}, {ORDINAL} SELECT line_id, pos FROM o")
def chronological_order(spark, folder):
    return ordinal(events(spark, folder), Order()).select("line_id", "pos")


ROLE = f"""{ORDINAL}, r AS (SELECT *, CASE WHEN pos < floor(n * 0.8) AND label = 0 THEN 'train' ELSE 'test' END AS role FROM o)"""


@query("line_split", f"WITH {EV}, {ROLE} SELECT line_id, label, role FROM r", ints=("label",))
def line_split(spark, folder):
    return split.line_split(events(spark, folder)).select("line_id", "label", "role")


@query(
    "line_split_statistics",
    f"""WITH {EV}, {ROLE} SELECT count(CASE WHEN role = 'train' THEN 1 END) AS train_normal, count(CASE WHEN role = 'test' THEN 1 END) AS test_total,
  count(CASE WHEN role = 'test' AND label = 1 THEN 1 END) AS test_anomaly, count(CASE WHEN role = 'test' AND label = 0 THEN 1 END) AS test_normal FROM r""",
)
def line_split_statistics(spark, folder):
    return split.split_statistics(split.line_split(events(spark, folder)))


@query(
    "test_union",
    f"""WITH {EV}, {ROLE} SELECT line_id, 0 AS label FROM r WHERE pos >= floor(n * 0.8) AND label = 0
UNION ALL SELECT line_id, 1 FROM r WHERE label = 1""",
    ints=("label",),
)
def test_union(spark, folder):
    rows = split.line_split(events(spark, folder)).filter("role = 'test'")
    normal = rows.filter("label = 0").select("line_id", "label")
    return normal.unionByName(rows.filter("label = 1").select("line_id", "label"))


@query(
    "split_leakage",
    f"""WITH {EV}, {ROLE} SELECT (SELECT count(*) FROM r a JOIN r b ON a.line_id = b.line_id WHERE a.role = 'train' AND b.role = 'test') AS shared,
  (SELECT max(us) FROM r WHERE role = 'train') AS last_train, (SELECT min(us) FROM r WHERE role = 'test' AND label = 0) AS first_test,
  CASE WHEN (SELECT max(us) FROM r WHERE role = 'train') <= (SELECT min(us) FROM r WHERE role = 'test' AND label = 0) THEN 1 ELSE 0 END AS ordered""",
    ints=("ordered",),
)
def split_leakage(spark, folder):
    rows = split.line_split(events(spark, folder))
    return split.leakage(rows.filter("role = 'train'"), rows.filter("role = 'test'"))


@query(
    "train_test_shared_text",
    f"""WITH {LN}, k AS (SELECT raw, CASE WHEN owner < (SELECT count(*) * 4 // 5 FROM documents) THEN 'train' ELSE 'test' END AS role FROM ln WHERE trim(raw) <> '')
SELECT raw, count(*) AS n FROM k WHERE role = 'test' AND raw IN (SELECT raw FROM k WHERE role = 'train') GROUP BY raw""",
)
def train_test_shared_text(spark, folder):
    cut = table(spark, folder, "documents").agg(F.floor(F.count("*") * 4 / 5)).scalar()
    rows = lines(spark, folder).filter(F.trim("raw") != "")
    train, test = rows.filter(F.col("owner") < cut), rows.filter(F.col("owner") >= cut)
    # Copies are counted before the join, so a line repeated without end is one row.
    return test.groupBy("raw").agg(F.count("*").alias("n")).join(
        train.select("raw").distinct(), "raw", "left_semi"
    )


@query(
    "conversation_blocks",
    """SELECT conv_id AS block, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, trim(text, ' ') AS line,
  min(turn) OVER (PARTITION BY conv_id) AS first_seen, count(*) OVER (PARTITION BY conv_id) AS n_lines FROM conversations""",
)
def conversation_blocks(spark, folder):
    return split.group_blocks(
        table(spark, folder, "conversations"), "conv_id", order=("turn",), text="text"
    )


BLOCKS = """cb AS (SELECT conv_id AS block, min(conv_id * 2147483648 + turn) AS first_seen, max(CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END) AS bad, count(*) AS turns FROM conversations GROUP BY 1),
bl AS (SELECT block, first_seen, CASE WHEN turns < 5 THEN 0 ELSE bad END AS label FROM cb)"""


def blocks(spark, folder):
    """Conversations as blocks; labels (long turns) are known from five turns on."""
    talks = table(spark, folder, "conversations")
    grouped = talks.groupBy(F.col("conv_id").alias("block")).agg(
        F.min(F.shiftleft("conv_id", 31) + F.col("turn")).alias("first_seen")
    )
    known = talks.groupBy(F.col("conv_id").alias("block")).agg(
        F.max((F.length("text") > 1500).cast("int")).alias("label"), F.count("*").alias("turns")
    ).filter("turns >= 5")
    return split.with_block_labels(grouped, known)


@query("block_labels", f"WITH {BLOCKS} SELECT block, first_seen, label FROM bl", ints=("label",))
def block_labels(spark, folder):
    return blocks(spark, folder)


@query(
    "block_split",
    f"""WITH {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first_seen, block) AS rn, count(*) OVER (PARTITION BY label) AS n FROM bl)
SELECT block, label, CASE WHEN label = 0 AND rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM o""",
    ints=("label",),
)
def block_split(spark, folder):
    return split.block_split(blocks(spark, folder)).select("block", "label", "role")


@query(
    "line_label_alignment",
    f"""WITH {EV}, s AS (SELECT line_id, score FROM ev), l AS (SELECT line_id, label FROM ev WHERE kind <> 'signup')
SELECT count(*) AS lines, count(l.line_id) AS labelled, count(*) - count(l.line_id) AS missing,
  (SELECT count(*) FROM l WHERE line_id NOT IN (SELECT line_id FROM s)) AS orphans FROM s LEFT JOIN l USING (line_id)""",
)
def line_label_alignment(spark, folder):
    df = events(spark, folder)
    labels = df.filter("kind <> 'signup'").select("line_id", "label")
    scores = df.select("line_id", "score")
    orphans = labels.join(scores, "line_id", "left_anti").agg(F.count("*")).scalar()
    return scores.join(labels, "line_id", "left").agg(
        F.count("*").alias("lines"), F.count("label").alias("labelled"),
        F.count_if(F.col("label").isNull()).alias("missing"),
    ).withColumn("orphans", orphans)


@query(
    "aligned_lines",
    f"""WITH {EV} SELECT line_id, us, label, score FROM ev WHERE kind <> 'signup'""", ints=("label",),
)
def aligned_lines(spark, folder):
    df = events(spark, folder)
    labels = df.filter("kind <> 'signup'").select("line_id", "label")
    times = df.select("line_id", "us")
    return df.select("line_id", "score").join(labels, "line_id").join(times, "line_id")
