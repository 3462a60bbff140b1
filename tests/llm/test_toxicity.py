import zlib

import numpy as np
import pytest

from omenlog.llm import linear, toxicity

BAD, FINE = ["vilor", "grumak", "snarpit"], ["stone", "river", "cloud", "meadow", "lantern", "harbour"]


def corpus(n=240):
    draw = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        words = list(draw.choice(FINE, 30))
        toxic = int(i % 4 == 0)
        if toxic:
            words[int(draw.integers(30))] = BAD[i % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    got = toxicity.score(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    truth = {i: t for i, _, t in labels}
    held = got[got["held_out"]]
    assert set(held["doc_id"]) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() >= 0.95


def test_odd_rows(spark):
    docs, labels = corpus()
    odd = docs + [(None, "river " * 50), (900, None), (901, ""), (902, "cloud " * 60_000 + BAD[0]), docs[1], docs[1]]
    rows = [(i, t, 7.0, "x") for i, t in odd]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string")
    marks = labels + [(None, 1, 1), (900, None, None), (docs[1][0], 1, None)]
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(table, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.toPandas()
    assert len(got) == len(odd) and got["score"].notna().all()
    assert not got[got["doc_id"].isna()]["held_out"].any()
    assert got[got["doc_id"] == 902]["predicted"].tolist() == [1]
    assert got[got["doc_id"].isin([900, 901])]["score"].nunique() == 1
    assert got[got["doc_id"] == docs[1][0]]["score"].nunique() == 1
    kept = toxicity.clean(table, known)
    assert kept.columns == table.columns and kept.count() == (got["predicted"] == 0).sum()


@pytest.mark.parametrize("labels, want", [([], 0), ([(1, 1, 1)], 1), ([(1, 1, 0), (2, 1, 0)], 0)])
def test_without_both_classes(spark, labels, want):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert got["predicted"].tolist() == [want] * 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_pieces_of_a_long_text_give_the_same_features(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdé ß漢"), 5000))
    whole = toxicity.GRAMS.distinct(text)
    monkeypatch.setattr(linear, "PIECE", 37)
    assert (toxicity.GRAMS.distinct(text) == whole).all()
    place = linear.placement(whole[::3])
    assert (toxicity.GRAMS.columns(text, place) == np.arange(len(whole[::3]))).all()


def test_logistic_finds_the_minimum():
    draw = np.random.default_rng(0)
    dense = draw.normal(size=(200, 5)) * (draw.random((200, 5)) < 0.6)
    y = (dense @ [1, -2, 0.5, 0, 1] + draw.normal(size=200) > 0).astype(float)
    w = linear.logistic(linear.Dense(dense), y, np.ones(200), 1.0, rounds=200)
    p = linear.sigmoid(dense @ w[:-1] + w[-1])
    assert np.abs(dense.T @ (p - y) + w[:-1]).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_sparse_and_dense_rows_agree():
    draw = np.random.default_rng(1)
    scale, lists = draw.normal(size=9), [[0, 3], [], [8], list(range(9))]
    dense = np.array([[scale[j] if j in x else 0 for j in range(9)] for x in lists])
    sparse, w, g = linear.Sparse.of(lists, scale), draw.normal(size=9), draw.normal(size=4)
    assert np.allclose(sparse.times(w), dense @ w) and np.allclose(sparse.transposed_times(g), dense.T @ g)
