"""Normalising, labels, block ids, words and distinct lines over the documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from omenlog.functions import normalise as nz
from omenlog.functions import words as wd
from omenlog.operators import dedup, parse, pieces, split, surprise
from omenlog.plans.inputs import EV, LN, events, lines, table
from omenlog.plans.registry import query
from omenlog.session import checkpointed, new_folder
from omenlog.sources import text as files


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def masks_sql(source: str, masks) -> str:
    for pattern, name, _ in masks:
        pattern = pattern.removeprefix("(?=[JFMASOND])")  # RE2 has no look-ahead
        source = f"regexp_replace({source}, {quoted(nz.portable(pattern))}, {quoted(name)}, 'g')"
    return source


GENERIC = "trim(regexp_replace(" + masks_sql(
    "strip_accents(lower(raw))", ((nz.BLOCK_ID, "BLK", ""), (nz.IP, "IP", ""), (r"\d+", "NUM", ""))
) + ", '[^a-zA-Z]+', ' ', 'g'))"
HDFS = "trim(regexp_replace(" + masks_sql("strip_accents(lower(raw))", nz.HDFS_MASKS) + ", '[^a-zA-Z]+', ' ', 'g'))"
THUNDERBIRD = "trim(regexp_replace(strip_accents(lower(" + masks_sql(
    "substr(raw, 3)", nz.THUNDERBIRD_MASKS
) + ")), '[^a-zA-Z<>]+', ' ', 'g'))"
NORM = f"nm AS (SELECT line_id, owner, source, norm FROM (SELECT *, {GENERIC} AS norm FROM ln) WHERE norm <> '')"


def normal_lines(spark, folder, profile="generic"):
    """Lines with their template; lines that become empty are dropped with their id."""
    return parse.normalise_lines(lines(spark, folder), profile)


@query("normalise_generic", f"WITH {LN}, {NORM} SELECT line_id, norm FROM nm")
def normalise_generic(spark, folder):
    return normal_lines(spark, folder).select("line_id", "norm")


@query(
    "normalise_generic_options",
    f"""WITH {LN}, n AS (SELECT line_id, string_split(trim(regexp_replace(strip_accents(raw), '[^a-zA-Z]+', ' ', 'g')), ' ') AS w FROM ln)
SELECT line_id, array_to_string(w[3:], ' ') AS norm FROM n WHERE len(w) > 2""",
)
def normalise_generic_options(spark, folder):
    letters_only = nz.Profile(skip=2, lower=False)
    return normal_lines(spark, folder, letters_only).select("line_id", "norm")


@query("normalise_hdfs", f"WITH {LN}, n AS (SELECT line_id, {HDFS} AS norm FROM ln) SELECT * FROM n WHERE norm <> ''")
def normalise_hdfs(spark, folder):
    return normal_lines(spark, folder, "hdfs").select("line_id", "norm")


@query(
    "normalise_thunderbird",
    f"WITH {LN}, n AS (SELECT line_id, {THUNDERBIRD} AS norm FROM ln) SELECT * FROM n WHERE norm <> ''",
)
def normalise_thunderbird(spark, folder):
    return normal_lines(spark, folder, "thunderbird").select("line_id", "norm")


@query("normalise_bgl")
def normalise_bgl(spark, folder):
    return normal_lines(spark, folder, replace(nz.PROFILES["bgl"], skip=3)).select("line_id", "norm")


@query("accent_folding", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def accent_folding(spark, folder):
    return table(spark, folder, "documents").select("doc_id", nz.fold_accents(F.col("text")).alias("folded"))


@query(
    "raw_line_source",
    f"WITH {LN} SELECT line_id, owner, line_no, raw FROM ln", ints=("line_no",),
)
def raw_line_source(spark, folder):
    return lines(spark, folder).select("line_id", "owner", "line_no", "raw")


@query(
    "capped_line_read",
    f"WITH {LN} SELECT line_id, trim(raw, ' ') AS line FROM ln WHERE trim(raw, ' ') <> '' ORDER BY line_id LIMIT 500",
)
def capped_line_read(spark, folder):
    from omenlog.sources.text import capped

    return capped(lines(spark, folder), 500)


@query(
    "marker_labels",
    f"WITH {LN} SELECT line_id, CASE WHEN substr(raw, 1, 1) = 'T' THEN 0 ELSE 1 END AS label FROM ln", ints=("label",),
)
def marker_labels(spark, folder):
    return lines(spark, folder).select("line_id", nz.marker_label(F.col("raw"), "T").alias("label"))


@query(
    "normal_abnormal_partition",
    f"""WITH {LN} SELECT source, count(CASE WHEN substr(raw, 1, 1) = 'T' THEN 1 END) AS normal,
  count(CASE WHEN substr(raw, 1, 1) <> 'T' THEN 1 END) AS abnormal FROM ln GROUP BY source""",
)
def normal_abnormal_partition(spark, folder):
    df = lines(spark, folder).withColumn("label", nz.marker_label(F.col("raw"), "T"))
    return df.groupBy("source").agg(
        F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("abnormal")
    )


@query(
    "word_labels",
    f"""WITH {EV}, w AS (SELECT line_id, CASE kind WHEN 'error' THEN 'anomaly' WHEN 'view' THEN ' Normal ' WHEN 'click' THEN '-' WHEN 'signup' THEN '1' ELSE 'R02' END AS word FROM ev)
SELECT line_id, CASE WHEN trim(word) IN ('1', 'anomaly', 'Anomaly', 'abnormal') THEN 1 WHEN trim(word) IN ('0', 'normal', 'Normal') THEN 0
  WHEN trim(word) = '-' THEN 0 ELSE 1 END AS label FROM w""",
    ints=("label",),
)
def word_labels(spark, folder):
    kind = F.col("kind")
    word = (
        F.when(kind == "error", "anomaly").when(kind == "view", " Normal ").when(kind == "click", "-")
        .when(kind == "signup", "1").otherwise("R02")
    )
    return events(spark, folder).select("line_id", nz.word_label(word).alias("label"))


@query(
    "text_file_lines",
    f"WITH {LN} SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_id) - 1 AS line_no, raw FROM ln",
)
def text_file_lines(spark, folder):
    """One log file for each source, written and read back with its line numbers."""
    path = new_folder(spark, "logs")
    logs = lines(spark, folder).repartition("source").sortWithinPartitions("source", "line_id")
    logs.select("source", "raw").write.partitionBy("source").text(path)
    read = files.read_lines(spark, path)
    return read.select(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source"), "line_no", "raw")


@query(
    "text_file_labels",
    f"""WITH {EV}, w AS (SELECT key % 4 AS part, line_id, kind FROM ev WHERE kind <> 'signup')
SELECT part, row_number() OVER (PARTITION BY part ORDER BY line_id) - 1 AS line_no,
  CASE WHEN kind IN ('error', 'purchase') THEN 1 ELSE 0 END AS label FROM w""",
    ints=("part", "label"),
)
def text_file_labels(spark, folder):
    """Label files, one word a line with blank lines between, written and read back."""
    path = new_folder(spark, "label-files")
    kind = F.col("kind")
    word = (
        F.when(kind == "error", "anomaly").when(kind == "view", " Normal ").when(kind == "signup", "")
        .when(kind == "purchase", "1").otherwise("-")
    )
    rows = events(spark, folder).select((F.col("key") % 4).alias("part"), "line_id", word.alias("word"))
    rows = rows.repartition("part").sortWithinPartitions("part", "line_id")
    rows.select("part", "word").write.partitionBy("part").text(path)
    read = files.read_line_labels(spark, path)
    return read.select(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("int").alias("part"), "line_no", "label")


@query(
    "block_ids_in_lines",
    f"""WITH {LN} SELECT line_id, coalesce(nullif(regexp_extract(raw, '[0-9]+'), ''), '') AS first_id,
  len(list_distinct(regexp_extract_all(raw, '[0-9]+'))) AS ids FROM ln""",
)
def block_ids_in_lines(spark, folder):
    return lines(spark, folder).select(
        "line_id",
        F.coalesce(nz.block_id(F.col("raw"), r"\d+"), F.lit("")).alias("first_id"),
        F.size(nz.block_ids(F.col("raw"), r"\d+")).alias("ids"),
    )


@query(
    "lines_per_block_id",
    f"""WITH {LN}, x AS (SELECT line_id, unnest(list_distinct(regexp_extract_all(raw, '[0-9]+'))) AS block FROM ln)
SELECT block, count(*) AS n_lines, min(line_id) AS first_seen FROM x GROUP BY block""",
)
def lines_per_block_id(spark, folder):
    found = split.explode_blocks(lines(spark, folder).select("line_id", "raw"), "[0-9]+")
    return found.groupBy("block").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_seen"))


@query(
    "lines_grouped_by_block",
    f"""WITH {LN}, x AS (SELECT line_id, trim(raw, ' ') AS raw, unnest(list_distinct(regexp_extract_all(raw, '[0-9]+'))) AS block FROM ln)
SELECT block, row_number() OVER w - 1 AS pos, raw AS line, min(line_id) OVER (PARTITION BY block) AS first_seen,
  count(*) OVER (PARTITION BY block) AS n_lines FROM x WINDOW w AS (PARTITION BY block ORDER BY line_id)""",
)
def lines_grouped_by_block(spark, folder):
    found = split.explode_blocks(lines(spark, folder).select("line_id", "raw"), "[0-9]+")
    return split.group_blocks(found, "block")


@query(
    "dedup_ratio",
    f"WITH {LN}, {NORM} SELECT count(*) AS lines, count(DISTINCT norm) AS distinct_lines, 1 - count(DISTINCT norm) / count(*) AS saved FROM nm",
    digits={"saved": 6},
)
def dedup_ratio(spark, folder):
    return dedup.dedup_ratio(normal_lines(spark, folder))


@query(
    "distinct_lines_first_seen",
    f"WITH {LN}, {NORM} SELECT norm, min(line_id) AS first_line, count(*) AS copies FROM nm GROUP BY norm",
)
def distinct_lines_first_seen(spark, folder):
    return dedup.distinct_lines(normal_lines(spark, folder))


@query(
    "score_distinct_lines_once",
    f"WITH {LN}, {NORM} SELECT line_id, length(norm) - length(replace(norm, ' ', '')) + 1 AS n_words, length(norm) AS n_letters FROM nm",
)
def score_distinct_lines_once(spark, folder):
    def score(once):
        return once.withColumns({"n_words": F.size(wd.words(F.col("norm"))), "n_letters": F.length("norm")})

    out = dedup.score_once(normal_lines(spark, folder), score)
    return out.select("line_id", "n_words", "n_letters")


WORDS = "wo AS (SELECT unnest(string_split(norm, ' ')) AS word FROM nm), wc AS (SELECT word, count(*) AS n FROM wo GROUP BY word)"


@query("word_frequencies", f"WITH {LN}, {NORM}, {WORDS} SELECT word, n FROM wc")
def word_frequencies(spark, folder):
    return surprise.word_counts(normal_lines(spark, folder))


@query(
    "log_vocabulary",
    f"""WITH {LN}, {NORM}, {WORDS}, sp(id, word) AS (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]'), (4, '[MASK]')),
b AS (SELECT row_number() OVER (ORDER BY n DESC, word) + 4 AS id, word, n FROM wc WHERE n >= 2 QUALIFY id < 1000)
SELECT id, word, 0 AS n FROM sp UNION ALL SELECT * FROM b""",
    ints=("id", "n"),
)
def log_vocabulary(spark, folder):
    return surprise.vocabulary(normal_lines(spark, folder), size=1000, min_frequency=2)


@query(
    "learned_pieces",
    f"""WITH RECURSIVE {LN}, {NORM}, {WORDS},
b AS (SELECT row_number() OVER (ORDER BY n DESC, word) + 4 AS id, word FROM wc WHERE n >= 2 QUALIFY id < 300),
al AS (SELECT DISTINCT unnest(string_split(word, '')) AS word FROM b),
voc AS (SELECT * FROM b UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY word), word FROM al
  WHERE word NOT IN (SELECT word FROM b)),
dw AS (SELECT DISTINCT word FROM wo),
ends AS (SELECT word, s, unnest(range(1, len(word) - s + 2)) AS l FROM (SELECT word, unnest(range(1, len(word) + 1)) AS s FROM dw)),
best AS (SELECT e.word, s, max(l) AS l, arg_max(v.id, l) AS id FROM ends e JOIN voc v ON v.word = substr(e.word, s, l) GROUP BY ALL),
walk AS (SELECT word, CAST(1 AS BIGINT) AS s, 0 AS n, CAST(NULL AS BIGINT) AS first_id, CAST(0 AS BIGINT) AS last FROM dw
  UNION ALL SELECT w.word, w.s + b.l, n + 1, coalesce(first_id, b.id), w.s - 1 FROM walk w JOIN best b ON w.word = b.word AND w.s = b.s),
cut AS (SELECT * FROM walk WHERE s = len(word) + 1),
pl AS (SELECT line_id, unnest(string_split(norm, ' ')) AS word, unnest(range(len(string_split(norm, ' ')))) AS pos FROM nm)
SELECT line_id, pos, coalesce(first_id, 1) AS first_id, coalesce(cut.n, 1) AS n_pieces, coalesce(last, 0) AS last_start
FROM pl LEFT JOIN cut USING (word)""",
    ints=("pos", "first_id", "n_pieces", "last_start"),
)
def learned_pieces(spark, folder):
    df = checkpointed(normal_lines(spark, folder).select("line_id", "norm"))
    known = pieces.learned(df, size=300)
    words = df.select("line_id", wd.words(F.col("norm")).alias("w")).withColumn("p", pieces.cut(F.col("w"), known))
    return words.select("line_id", F.posexplode("p").alias("pos", "p")).select(
        "line_id", "pos", F.get("p", F.lit(0))["id"].alias("first_id"), F.size("p").alias("n_pieces"),
        F.element_at("p", -1)["start"].alias("last_start"))


@query(
    "rare_words",
    f"WITH {LN}, {NORM}, {WORDS} SELECT word, n FROM wc WHERE n <= (SELECT quantile_cont(n, 0.1) FROM wc)",
)
def rare_words(spark, folder):
    return surprise.rare_words(normal_lines(spark, folder))


@query(
    "mined_templates",
    f"WITH {LN}, {NORM} SELECT norm, count(*) AS n FROM nm GROUP BY norm HAVING count(*) >= 3",
)
def mined_templates(spark, folder):
    return surprise.templates(normal_lines(spark, folder), min_frequency=3)


@query(
    "masked_word_variants",
    f"""WITH {LN}, {NORM}, a AS (SELECT line_id, string_split(norm, ' ') AS w FROM nm),
p AS (SELECT line_id, w, unnest(range(len(w))) AS pos FROM a)
SELECT line_id, pos, w[pos + 1] AS word, coalesce(w[pos], '<s>') AS "left", coalesce(w[pos + 2], '</s>') AS "right" FROM p""",
    ints=("pos",),
)
def masked_word_variants(spark, folder):
    return surprise.positions(normal_lines(spark, folder), keep=["line_id"])


@query(
    "words_to_pieces",
    f"""WITH {LN}, a AS (SELECT line_id, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS w FROM ln),
p AS (SELECT line_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM a),
q AS (SELECT *, regexp_extract_all(word, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]') AS pc FROM p)
SELECT line_id, pos, coalesce(pc[1], '') AS first_piece, len(pc) AS n_pieces FROM q""",
    ints=("pos", "n_pieces"),
)
def words_to_pieces(spark, folder):
    df = lines(spark, folder).select("line_id", F.posexplode(wd.words(F.col("raw"))).alias("pos", "word"))
    cut = df.withColumn("pc", wd.pieces(F.col("word")))
    return cut.select(
        "line_id", "pos", F.coalesce(F.get("pc", F.lit(0)), F.lit("")).alias("first_piece"),
        F.size("pc").alias("n_pieces"),
    )


def packed(spark, folder, name, key, text, budget):
    df = table(spark, folder, name).select(F.col(key).alias("owner"), wd.words(F.col(text)).alias("w"))
    df = df.withColumn("win", wd.windows(F.col("w"), budget))
    return df.select("owner", F.posexplode("win").alias("pos", "win")).groupBy("owner", "win").agg(
        F.count("*").alias("n_words"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query("packed_page_windows")
def packed_page_windows(spark, folder):
    return packed(spark, folder, "pages", "page_id", "html", 510)


@query("packed_document_windows")
def packed_document_windows(spark, folder):
    return packed(spark, folder, "documents", "doc_id", "text", 510)


@query(
    "packed_windows_of_single_pieces",
    f"""WITH {LN}, {NORM}, a AS (SELECT line_id, len(string_split(norm, ' ')) AS n FROM nm)
SELECT line_id, n AS n_words, (n + 31) // 32 AS n_windows FROM a""",
)
def packed_windows_of_single_pieces(spark, folder):
    df = normal_lines(spark, folder).select("line_id", wd.words(F.col("norm")).alias("w"))
    return df.select(
        "line_id", F.size("w").alias("n_words"), (F.array_max(wd.windows(F.col("w"), 32)) + 1).alias("n_windows")
    )
