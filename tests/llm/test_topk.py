import math

import numpy as np
import pytest

from omenlog.llm import topk


def plain(rows, k, scale=64):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(fine) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("values", ["smooth", "few", "large"])
def test_against_brute_force(spark, monkeypatch, values):
    draw = np.random.default_rng(2)
    v = {"smooth": draw.normal(size=(400, 8)), "few": draw.integers(-2, 3, size=(400, 4)) / 64.0,
         "large": draw.normal(size=(60, 4)) * 1e6}[values]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(table).collect())
    assert got == plain(rows, 20)


def searched(rows, queries=30, k=20):
    ids = np.arange(len(rows))
    found = topk.search(rows[:queries], ids[:queries], rows, ids, ids, k)
    for q in range(queries):
        scores = rows @ rows[q]
        scores[q] = -(10**9)
        want = np.lexsort((ids, -scores))[:k]
        assert found.kept[q][1].tolist() == want.tolist() and found.kept[q][0].tolist() == scores[want].tolist()
    return found.read / found.entries


def test_share_of_the_lists_that_is_read(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 500)
    draw = np.random.default_rng(4)
    even = searched(draw.integers(-40, 40, size=(3000, 16)))
    skewed = searched(np.floor(draw.lognormal(0, 1, size=(3000, 16)) * draw.lognormal(0, 1.5, size=(3000, 1))).astype(int))
    few = searched(np.where(draw.random((3000, 16)) < 0.1, draw.integers(1, 60, size=(3000, 16)), 0))
    assert even <= 1 and skewed < 0.5 and few < 0.5


def test_a_query_reads_no_further_than_it_must():
    rows = np.arange(1600)[:, None] * np.ones((1, 3), dtype=int)
    ids = np.arange(1600)
    found = topk.search(rows[-1:], ids[-1:], rows, ids, ids, 20)
    assert found.kept[0][1].tolist() == list(range(1598, 1578, -1))
    assert found.read == 3 * 100 and found.entries == 3 * 1600  # one round of the first sixteenth


def test_cursors_bound_what_is_unread():
    draw = np.random.default_rng(6)
    rows, queries = draw.integers(-9, 9, size=(50, 5)).astype(float), draw.integers(-9, 9, size=(7, 5)).astype(float)
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    lists, scores, seen = topk.Lists(rows), queries @ rows.T, 0
    for depth in (1, 15, 30, 50):
        seen = seen + weights @ lists.advance(depth).T
        assert (seen + (weights * lists.cursor) @ lists.unread.T >= scores).all()
        assert (seen + (weights * lists.far) @ lists.unread.T <= scores).all()
    assert (seen == scores).all() and not lists.unread.any()


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (20, [0.5]), (21, []), (40, [-1.0, 0.01]), (41, [0.0, 0.0]), (42, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(table)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")).count() == 0
