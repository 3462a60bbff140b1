"""URL filters: explicit host and path rules, and association rules mined over URL tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.session import checkpointed

#: host and path prefix, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A combination must be held by this share of the labelled pages, and by so many of them.
SUPPORT, LEAST_PAGES = 0.002, 12
#: A rule's confidence must be so many times the share of bad pages among the labelled ones.
LIFT = 1.3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The item that marks a page to be blocked; a token never has an upper-case letter.
_BLOCK = "BLOCK"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL in order, as one text: runs of a-z and of digits (each as #)."""
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "[0-9]+", "#")
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(F.regexp_replace(plain, "[^a-z#]+", " ")), " "))), " ")


def explicit(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host or subdomain, and path prefix) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, _, prefix = text.partition("/")
        name = name.lower()
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def blocked_labels(labels: DataFrame) -> DataFrame:
    """``id, bad``: a page is bad if any of its labels says low quality or toxic."""
    known = F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.filter(known).groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad"))


def _words(url: Column) -> Column:
    return F.filter(F.split(tokens(url), " "), lambda t: t != "")


def joined_tokens(known: DataFrame, least: int) -> DataFrame:
    """``token, item``: tokens of at least ``least`` bad pages; those of exactly the same pages share an item.

    Tokens that stand on the same labelled pages have equal support in every combination, so one of
    them mines for all.  Equal sets of pages are found by their size and two hashes.
    """
    held = known.select("row", "bad", F.explode("words").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("hits"),
        *[F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (1, 2)])
    held = held.filter(F.col("hits") >= least)
    item = held.groupBy("n", "h1", "h2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return item.select(F.explode("tokens").alias("token"), "item")


def mined(
    pages: DataFrame, labels: DataFrame, *, support: float = SUPPORT, least_pages: int = LEAST_PAGES,
    confidence: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rules ``items, size, key`` and the items ``token, item`` they are made of.

    FP-growth over the items of each labelled page and its label: tokens that stand on exactly the
    same labelled pages are one item, so a long URL that many pages repeat is one item and not all
    subsets of its tokens.  Kept are rules that end in the label, of any number of items, with at
    least the given support and confidence (by default ``LIFT`` times the share of bad pages); a
    rule that holds all items of another one says nothing new and is left out.  ``key`` is the
    rarest item of the rule, its place in the inverted index.  A page has an item if it holds any of
    its tokens, so no rule over tokens is lost.
    """
    spark = pages.sparkSession
    known = pages.join(blocked_labels(labels), F.col("page_id") == F.col("id"))
    known = checkpointed(known.select(F.monotonically_increasing_id().alias("row"), "bad", _words(F.col("url")).alias("words")))
    seen = known.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(least_pages, -int(-support * seen["n"] // 1))
    if confidence is None:
        confidence = min(1.0, LIFT * seen["bad"] / max(1, seen["n"]))
    items = checkpointed(joined_tokens(known, least))
    if seen["bad"] < least:
        return spark.range(0).select(
            F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("size"), F.lit("").alias("key")), items
    held = known.select("row", "bad", F.explode("words").alias("token")).join(items, "token")
    held = held.groupBy("row", "bad").agg(F.collect_set("item").alias("held"))
    baskets = F.when(F.col("bad"), F.concat("held", F.array(F.lit(_BLOCK)))).otherwise(F.col("held"))
    baskets = checkpointed(held.select(baskets.alias("items")))
    n = max(1, baskets.count())
    model = FPGrowth(minSupport=(least - 0.5) / n, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(_BLOCK)))
    rules = rules.select(F.array_sort("antecedent").alias("items"))
    rules = checkpointed(rules.withColumn("size", F.size("items")))
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    placed = rules.select("items", "size", F.explode("items").alias("token")).join(single, "token")
    placed = placed.groupBy("items", "size").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return smallest(checkpointed(placed)), items


def smallest(rules: DataFrame) -> DataFrame:
    """The rules that hold no other rule, found by number of tokens."""
    for size in sorted(r["size"] for r in rules.select("size").distinct().collect())[:-1]:
        short = rules.filter(F.col("size") == size).select(F.col("items").alias("part"), F.col("key").alias("token"))
        longer = rules.filter(F.col("size") > size).select("items", F.explode("items").alias("token")).join(short, "token")
        implied = longer.filter(F.size(F.array_except("part", "items")) == 0).select("items").distinct()
        rules = checkpointed(rules.join(implied, "items", "left_anti"))
    return rules


def blocked_sets(pages: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``set``: the distinct token sets of ``pages`` that have all items of some rule."""
    sets = pages.select(tokens(F.col("url")).alias("set")).distinct()
    held = sets.select("set", F.explode(F.split("set", " ")).alias("token")).join(items, "token")
    held = held.groupBy("set").agg(F.collect_set("item").alias("of"))
    met = held.select("set", "of", F.explode("of").alias("key")).join(rules, "key")
    return met.filter(F.size(F.array_intersect("items", "of")) == F.col("size")).select("set").distinct()


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **options,
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of ``pages``.

    The longest explicit rule that fits decides; other pages are blocked if a mined rule matches,
    else allowed.  Only distinct token sets meet the inverted index, so a hot host costs little.
    Null and empty URLs have empty parts and are allowed unless mined otherwise; null and repeated
    ids are ordinary rows (labels of a repeated id count for each of its rows); without labels
    nothing is mined; an empty table gives an empty result; other columns are not read.
    """
    pages = pages.select("page_id", "url")
    bad = checkpointed(blocked_sets(pages, *mined(pages, labels, **options))).withColumn("hit", F.lit(True))
    host, path = parts(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("set"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    known = known.join(bad, "set", "left")
    own = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return known.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def judge_sql(support: float = SUPPORT, least_pages: int = LEAST_PAGES, confidence: float | None = None) -> str:
    """The same for DuckDB: every combination of tokens that enough bad pages hold, grown token by token."""
    asked = str(confidence) if confidence is not None else f"least(1.0, {LIFT} * (SELECT sum(bad) / count(*) FROM tr))"
    cases = [
        (f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}'))"
         f" AND starts_with(path, '/{t.partition('/')[2]}')", t, what)
        for t, what in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    ]
    rule = " ".join(f"WHEN {fits} THEN '{t}'" for fits, t, _ in cases)
    verdict = " ".join(f"WHEN {fits} THEN '{what}'" for fits, _, what in cases)
    return f"""
    WITH RECURSIVE cut AS (
      SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    known AS (
      SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path,
        list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(
          translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}'), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), ' '), ' '))) AS toks
      FROM cut),
    bad AS (
      SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
    tr AS (SELECT row_number() OVER () AS r, list_filter(toks, lambda t: t <> '') AS toks, bad FROM known JOIN bad ON page_id = doc_id),
    least AS (SELECT greatest({least_pages}, ceil({support} * count(*))) AS k FROM tr),
    one AS (SELECT r, unnest(toks) AS t, bad FROM tr),
    often AS (SELECT t FROM one GROUP BY t HAVING sum(bad) >= (SELECT k FROM least)),
    tok AS (SELECT t, list(r) FILTER (bad = 1) AS b, list(r) AS a FROM one WHERE t IN (SELECT t FROM often) GROUP BY t),
    grown AS (
      SELECT [t] AS items, t AS last, b, a FROM tok
      UNION ALL
      SELECT list_append(items, tok.t), tok.t, list_intersect(grown.b, tok.b), list_intersect(grown.a, tok.a) FROM grown, tok
      WHERE tok.t > last AND len(list_intersect(grown.b, tok.b)) >= (SELECT k FROM least)),
    mined AS (SELECT items FROM grown WHERE len(b) / len(a) >= {asked}),
    hit AS (SELECT DISTINCT toks FROM known WHERE EXISTS (SELECT 1 FROM mined WHERE list_has_all(toks, items)))
    SELECT page_id, host, path, CASE {rule} END AS rule,
      coalesce(CASE {verdict} END, CASE WHEN hit.toks IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM known LEFT JOIN hit ON known.toks = hit.toks
    """
