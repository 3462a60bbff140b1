import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from omenlog.llm import periodic
from omenlog.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, power=4):
    """All runs by trying every period at every place."""
    found = {}
    n = len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, power * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1 if j > i else i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periods(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def random_texts():
    draw = np.random.default_rng(3)
    out = ["", " \n", "a", "a " * 6, "a " * 5, "a b " * 4, "a b " * 3 + "a", "x " * 4000, "a b a b a b a b a a a a a a b"]
    for k in range(300):
        words = list("abc"[: 1 + k % 3] if k % 4 else "abcdefgh")
        text = [words[i] for i in draw.integers(0, len(words), draw.integers(1, 60))]
        for _ in range(draw.integers(0, 4)):
            at, size = draw.integers(0, len(text)), draw.integers(1, 8)
            text[at:at] = text[at : at + size] * draw.integers(2, 9)
        out.append(" ".join(text))
    deep = ["a"]
    for _ in range(5):
        deep = (deep + ["b"]) * 4
    out.append(" ".join(deep))
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(random_texts()))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least, power in ((6, 4), (8, 3), (5, 6)):
        got = periodic.periodic_runs(table, least=least, power=power).collect()
        assert len(got) == len(rows)
        for r in got:
            words = WORD.findall(r["text"])
            want = brute(words, least, power)
            assert [tuple(x) for x in r["runs"]] == want, r["text"]
            assert r["collapsed"] == collapse(words, want)
    with pytest.raises(ValueError):
        periodic.periodic_runs(table, power=2)


def test_odd_rows(spark):
    text = "ß " * 7 + "\u00a0x\x1cy \u0301"  # these are no white space here
    rows = [(None, "a " * 9, 1), (1, None, 2), (1, "", 3), (2, text, 4), (2, text, 4), (3, "q\u2003z " * 50_000, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("doc_id", "a.b")
    got = periodic.periodic_runs(table)
    assert got.columns == ["a.b", "text", "runs", "collapsed"]
    seen = sorted((len(r["text"] or ""), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect())
    assert seen == sorted([
        (18, [(0, 9, 1)], "a"), (0, [], ""), (0, [], ""), (len(text), [(0, 7, 1)], "ß \u00a0x\x1cy \u0301"),
        (len(text), [(0, 7, 1)], "ß \u00a0x\x1cy \u0301"), (200_000, [(0, 50_000, 1)], "q\u2003z")])
    assert periodic.periodic_runs(table.limit(0)).count() == 0


def test_many_left_words_stay_cheap():
    # One passage after ever new words, and one long run: both would be quadratic if pairs were tried one by one.
    line = list(range(8))
    words = [w for k in range(20_000) for w in (100 + k, *line)] + [9] * 30_000 + [-1]
    got = periodic.stretches(np.array([-2, *words]) + 2, np.zeros(len(words) + 1, int), 6, 4)
    assert got == [(180_001, 30_000, 1)]


def test_query(spark, folder):
    got = QUERIES["op13_periodic_runs"](spark, folder).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    assert len(got) == len(docs) and got["n_runs"].gt(0).sum() >= 5
    for doc, text in zip(docs["doc_id"], docs["text"]):
        words = periods(doc, text)
        runs = brute(words)
        r = got.loc[doc]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        if best:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert pd.isna([r["start"], r["length"], r["period"], r["exponent_milli"]]).all()
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()


def test_rule_of_the_query(spark):
    rows = [(None, "a b c"), (4, None), (5, ""), *[(k, f"w{k} x\ty\u00a0 z  " * (k % 40)) for k in range(6, 300)]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in periodic.with_periods(table).collect()}
    assert got[None] == "a b c" and got[4] is None and got[5] == ""
    for doc, text in rows[3:]:
        assert WORD.findall(got[doc]) == periods(doc, text)
    longest = periodic.digests(periodic.periodic_runs(periodic.with_periods(table))).filter("n_runs = 0").first()
    assert longest["start"] is None and len(longest["runs_sha256"]) == 64
