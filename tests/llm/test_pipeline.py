"""Every stage on its own input against the operator's plain result, and the whole run."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from omenlog.llm import mixing, quality, simhash, toxicity
from omenlog.llm.queries import TOKENIZER

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of every stage, written and read like in a run."""
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, FOLDER)
        done.write.parquet(str(at / name))
        out.append((docs, spark.read.parquet(str(at / name))))
        docs = out[-1][1]
    return out


def test_stages(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "encoding"]
    assert all(got.columns == names for _, got in stages[:4])


@pytest.mark.parametrize("k, operator", [(0, toxicity.score), (1, quality.score)])
def test_rejected_documents_go(spark, stages, k, operator):
    docs, got = stages[k]
    scores = operator(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).toPandas()
    stay = scores["predicted"] == (0 if k == 0 else 1)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(scores[stay]["doc_id"])
    assert got.subtract(docs).count() == 0


def test_one_of_each_group_stays(stages):
    docs, got = stages[2]
    groups = simhash.near_duplicates(docs).toPandas().groupby("component_id")["doc_id"].min()
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(groups)


def test_mixing_keeps_all_and_orders_files(stages):
    docs, got = stages[3]
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in got.collect())
    sources = Counter(r["source"] for r in docs.collect())
    want = mixing.mix(docs).orderBy("mix_position").toPandas()["source"].tolist()
    files = sorted(got.inputFiles())
    in_order = [(r["source"], r["doc_id"]) for f in files for r in docs.sparkSession.read.parquet(f).collect()]
    assert [s for s, _ in in_order] == want and Counter(s for s, _ in in_order) == sources
    last = stages[4][1].orderBy("mix_file", "mix_row").collect()
    assert [(r["source"], r["doc_id"]) for r in last] == in_order


def test_encoding(stages):
    docs, got = stages[4]
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        ids = library.encode(d["text"], add_special_tokens=False).ids
        assert np.frombuffer(rows[d["doc_id"]]["ids"], "<u4").tolist() == ids and rows[d["doc_id"]]["n_tokens"] == len(ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_sha256").toPandas()
    want = stages[-1][1].select("doc_id", "ids_sha256").toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_odd_documents(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some words here", None, "a", 15),
         (3, "long words " * 20_000, "en", "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert docs.count() >= 1
    empty = spark.read.parquet(os.path.join(FOLDER, "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0
        if "text" not in empty.columns:
            break


def test_columns_with_odd_names(spark):
    rows = [(k, None if k == 3 else f"text {k}", "x" if k % 3 else None, k, -k, "f", 7) for k in range(40)]
    names = ["doc_id", "text", "source", "a.b", "mix_position", "mix_file", "ids"]
    docs = spark.createDataFrame(rows, names)
    got = corpus_pipeline.mix_sources(spark, docs, FOLDER)
    assert got.columns == names and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    encoded = corpus_pipeline.encode(spark, docs, FOLDER).collect()
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in encoded} == {k: k != 3 for k in range(40)}
    empty = corpus_pipeline.mix_sources(spark, docs.limit(0), FOLDER)
    assert empty.columns == names and empty.count() == 0
