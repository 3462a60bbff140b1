import re
import time
from collections import Counter, defaultdict
from itertools import combinations, product

import duckdb
import pandas as pd
import pytest

from omenlog.llm import urls

CASES = {
    "http://a.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
    "https://net/": ("net", "/", "net/", "block"),
    "https://net": ("net", "", None, "allow"),
    "https://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
    "https://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
    "https://example.com/de": ("example.com", "/de", None, "allow"),
    "//x.org/fr/": ("", "", None, "allow"),
    "ftp://x.org/fr/?a://b.net/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://x.net?q/": ("x.net", "", None, "allow"),
    "http://x.net#a/b": ("x.net", "", None, "allow"),
    "http://x.net:80/": ("x.net:80", "/", None, "allow"),
    "http://É.net/": ("É.net", "/", "net/", "block"),
    "http://a.net/b://c.org/fr/": ("a.net", "/b://c.org/fr/", "net/", "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}
LABELS = "doc_id long, quality int, toxic int"


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string")
    got = {r[0]: tuple(r)[1:] for r in urls.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    assert got == dict(enumerate(CASES.values()))


def spam(n=400):
    """Pages with both words cheap and pills are bad; each word alone is fine."""
    pages, labels = [], []
    for i in range(n):
        words = [("cheap-pills", 0), ("cheap-tickets", 1), ("blue-pills", 1), ("garden", 1)][i % 4]
        pages.append((i, f"https://www.{words[0]}.example.org/en/{i}?page={i % 7}"))
        if i % 5:
            labels.append((i, words[1], 0))
    return pages, labels


def test_combinations_are_mined(spark):
    pages, labels = spam()
    table, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    rules = [set(r["items"]) for r in urls.mined(table, known, confidence=0.6)[0].collect()]
    assert {"cheap", "pills"} in rules and all({"cheap", "pills"} <= r for r in rules)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(table, known, confidence=0.6).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i, _ in pages}


def minimal_rules(pages, labels, confidence=0.6):
    """All combinations of tokens of labelled pages by counting each one."""
    bad = {i: q == 0 or t == 1 for i, q, t in labels}
    sets = [(frozenset(re.findall("[a-z#]+", re.sub("[0-9]+", "#", u))), bad[i]) for i, u in pages if i in bad]
    least = max(urls.LEAST_PAGES, -int(-urls.SUPPORT * len(sets) // 1))
    held, hits = Counter(), Counter()
    for (tokens, b), n in Counter(sets).items():
        for size in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), size):
                held[c] += n
                hits[c] += n * b
    rules = [frozenset(c) for c, n in held.items() if hits[c] >= least and hits[c] / n >= confidence]
    return {r for r in rules if not any(x < r for x in rules)}


def test_combinations_of_more_than_three_tokens(spark):
    """Pages are bad with all four words (or with wolf and moon); any three of the four are mostly good."""
    pages, labels = [], []
    for i in range(640):
        kind = i % 16
        words = [w for k, w in enumerate(("ash", "birch", "cedar", "elm")) if kind >> k & 1] + ["wolf"] * (i % 3 == 0) + ["moon"] * (i % 5 == 0)
        pages.append((i, "https://m.example.org/en/" + "-".join(words)))
        if i % 7:
            labels.append((i, int(kind < 15 and i % 15 > 0), 0))
    rules = minimal_rules(pages, labels)
    assert frozenset(("ash", "birch", "cedar", "elm")) in rules and frozenset(("moon", "wolf")) in rules
    table, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    mined, items = urls.mined(table, known, confidence=0.6)
    assert over_tokens(mined, items) == rules
    got = {r["page_id"]: r["verdict"] for r in urls.judge(table, known, confidence=0.6).collect()}
    want = {i: any(r <= set(re.findall("[a-z#]+", u)) for r in rules) for i, u in pages}
    assert got == {i: "block" if b else "allow" for i, b in want.items()}


def over_tokens(mined, items):
    """Rules over items as rules over tokens: one token of each item, in every way."""
    tokens = defaultdict(list)
    for r in items.collect():
        tokens[r["item"]].append(r["token"])
    return {frozenset(way) for r in mined.collect() for way in product(*[tokens[i] for i in r["items"]])}


def test_joined_tokens_lose_no_rule(spark):
    """Tokens that always come together are mined as one, and rules over single tokens stay what they are."""
    pages, labels = [], []
    for i in range(300):
        words = [["ant", "bee"], ["cat", "dog"], ["ant", "bee", "cat", "dog"], ["fox"]][i % 4] + ["yak"] * (i % 3 == 0)
        pages.append((i, "https://x.org/" + "-".join(words)))
        labels.append((i, int(i % 4 != 2 or i % 20 == 2), 0))
    pages += [(1000, "https://y.net/cat-bee"), (1001, "https://y.net/cat-owl")]
    table, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    mined, items = urls.mined(table, known, confidence=0.6)
    assert len({r["item"] for r in items.collect() if r["token"] in ("ant", "bee")}) == 1
    want = minimal_rules(pages, labels)
    assert frozenset(("bee", "cat")) in want and over_tokens(mined, items) == want
    got = {r["page_id"]: r["verdict"] for r in urls.judge(table, known, rules=(), confidence=0.6).collect()}
    assert got == {i: "block" if any(r <= set(re.findall("[a-z#]+", u)) for r in want) else "allow" for i, u in pages}


def test_one_long_address_on_many_pages(spark):
    """60 tokens on 20 labelled pages are one item, not 2 to the power of 60 combinations."""
    pages, labels = spam(80)
    long = "https://track.example.org/" + "-".join(f"{a}{b}" for a in "qrstuv" for b in "abcdefghij")
    pages += [(500 + i, long) for i in range(20)] + [(600, "https://other.org/qa-zz")]
    labels += [(500 + i, 0, 1) for i in range(20)]
    table, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    begin = time.monotonic()
    mined, items = urls.mined(table, known, confidence=0.6)
    rules = [r["items"] for r in mined.collect()]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(table, known, confidence=0.6).collect()}
    assert time.monotonic() - begin < 60
    assert len({r["item"] for r in items.collect() if len(r["token"]) == 2 and r["token"] != "en"}) == 1
    assert ["qa"] in rules and got[500] == got[600] == "block" and got[1] == "allow"


def test_rules_are_mined_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    pages, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "labels"))
    mined, items = urls.mined(pages.select("page_id", "url"), labels)
    assert mined.count() > 0
    plain = urls.judge(pages, labels.limit(0)).filter("verdict = 'block'").count()
    assert urls.judge(pages, labels).filter("verdict = 'block'").count() > plain


@pytest.mark.parametrize("least", [12, 10**6])
def test_sql_says_the_same(spark, least):
    pages, labels = spam()
    pages += [(1000 + i, u) for i, u in enumerate(CASES)] + [(None, "http://q.net/"), (5, "http://cheap.pills.org/"), (5, "http://cheap.pills.org/")]
    labels += [(None, 0, 1), (6, None, None), (7, 1, None), (7, None, 1), (7, 1, 0)]
    got = urls.judge(
        spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, verdict string"),
        spark.createDataFrame(labels, LABELS), least_pages=least).toPandas()
    con = duckdb.connect()
    con.register("p", pd.DataFrame(pages, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    con.register("l", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, CAST(url AS VARCHAR) AS url FROM p")
    con.execute("CREATE TABLE labels AS SELECT * FROM l")
    want = con.execute(urls.judge_sql(least_pages=least)).df()

    def plain(frame):
        cell = lambda x: "-" if pd.isna(x) else x if isinstance(x, str) else str(int(x))
        return sorted(tuple(map(cell, r)) for r in frame[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))

    assert plain(got) == plain(want)


def test_empty_tables_and_long_urls(spark):
    pages, labels = spam(60)
    known = spark.createDataFrame(labels, LABELS)
    table = spark.createDataFrame(pages + [(99, "http://x.org/" + "-".join("abc%d" % i + chr(97 + i % 26) for i in range(20_000)))], "page_id long, url string")
    assert urls.judge(table, known).count() == 61
    assert urls.judge(table.limit(0), known).count() == 0
