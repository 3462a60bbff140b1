import os

import numpy as np
import pytest

from omenlog.llm import ann


def exact(ids, v, k=20):
    """Each query's k best other rows, ties to smaller ids."""
    out = {}
    for a in np.flatnonzero(ids % 20 == 0):
        scores = (v * v[a]).sum(axis=1)
        order = [b for b in np.lexsort((ids, -scores)) if b != a][:k]
        out[int(ids[a])] = [(int(ids[b]), float(scores[b])) for b in order]
    return out


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_recall_and_scores(spark, monkeypatch, kind):
    draw = np.random.default_rng(8)
    v = draw.normal(size=(3000, 16))
    if kind == "clusters":
        v = draw.normal(size=(40, 16))[draw.integers(0, 40, 3000)] * 3 + v * 0.3
    v = v * draw.uniform(0.2, 3, size=(3000, 1)) if kind == "lengths" else v / np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "FIT_ROWS", 1000)
    monkeypatch.setattr(ann, "LIST", 60)
    ids = np.arange(3000)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got, want = found(ann.nearest(table)), exact(ids, v)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 20 and [(-s, i) for i, s in rows] == sorted((-s, i) for i, s in rows)
        assert all(s == (v[i] * v[q]).sum() for i, s in rows)


def test_given_embeddings(spark, folder):
    table = spark.read.parquet(os.path.join(folder, "embeddings.parquet"))
    pdf = table.toPandas()
    want = exact(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float))
    assert recall(found(ann.nearest(table)), want) >= 0.9


def test_clustered_data_reads_few_lists():
    draw = np.random.default_rng(9)
    v = draw.normal(size=(50, 16))[draw.integers(0, 50, 4000)] * 3 + draw.normal(size=(4000, 16)) * 0.2
    norm = np.sqrt((v * v).sum(axis=1)).max() * 1.0001
    index = ann.Index.fit(v[:2000], norm, 4000 * 4)
    who, lists = index.homes(v)
    sizes = np.bincount(lists, minlength=len(index.centroids))
    assert set(who) == set(range(4000)) and len(who) > 4000  # every vector, some more than once
    probes = index.probes(v[::20], sizes, 42)
    assert (probes @ sizes).mean() < 0.3 * sizes.sum() and (probes @ sizes >= 42).all()


def test_hot_vector_is_split_and_ties_go_to_small_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 64)
    draw = np.random.default_rng(10)
    v = np.concatenate([np.tile(draw.normal(size=(1, 8)), (300, 1)), draw.normal(size=(300, 8))])
    ids = np.arange(600)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got, want = found(ann.nearest(table)), exact(ids, v)
    hot = [q for q in want if q < 300]
    assert all(got[q] == want[q] for q in hot) and recall(got, want) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]),
            (None, [1.0, 1.0]), (20, [0.5]), (21, []), (22, [0.0, 0.0]), (40, [-1.0, 0.01]), (41, [3.0, 1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(table)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, got.collect()))
    fine = [(0, (1, 2)), (0, (1, 2)), (20, (0.5, 0)), (40, (-1, 0.01)), (41, (3, 1))]
    want = []
    for a, (i, q) in enumerate(fine):
        if i % 20 == 0:
            scores = sorted((-(q[0] * x[0] + q[1] * x[1]), j) for b, (j, x) in enumerate(fine) if b != a)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert got == sorted(want)
    assert ann.nearest(table.limit(0)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")).count() == 0
