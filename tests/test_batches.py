"""Work on the words of lines that is done in Arrow batches, against plain Python and Spark."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from omenlog.functions import normalise as nz
from omenlog.functions import scoring
from omenlog.functions.words import words
from omenlog.operators import classify, embedding, positions, surprise
from omenlog.plans import load
from omenlog.session import checkpointed

QUERIES = load()
ODD = ["", " ", " a  b\t", "a\nb\x0bc \x0c d\r", "é 日本 x", "a" * 37 + " b", None]


def jobs_of(spark, name, fn):
    """Spark jobs that ``fn`` starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_lines_are_cut_as_by_spark(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    want = [r[0] or [] for r in df.select(words(F.col("t"))).collect()]
    assert [x or [] for x in positions.split(pa.array(ODD, pa.string())).to_pylist()] == want


def test_words_are_cut_in_batches(spark):
    """The JVM cuts no line into words on its way to the tasks that count."""
    df = spark.createDataFrame([("a b c", 1, 1)], "line string, key long, copies long")
    assert "split(" not in surprise.counted(df)._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.createDataFrame([("b a b", 3), (" a\tc ", 1), ("", 2)], "line string, copies long")
    counts = surprise._counted_words(lines, "word")
    assert "split(" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {r["word"]: r["c"] for r in counts.collect()} == {"a": 4, "b": 6, "c": 1}


def test_blocks_give_back_their_arrays():
    columns = {"names": pa.array(["x", "", "yé"]).slice(1), "n": np.arange(300), "none": np.zeros(0, np.uint8), "texts": pa.array([], pa.string())}
    got = positions._unpacked(pa.scalar(positions._packed(**columns), pa.binary()))
    assert got["names"].to_pylist() == ["", "yé"] and got["n"].tolist() == list(range(300))
    assert not len(got["none"]) and not len(got["texts"])


def test_folding_of_whole_batches():
    texts = ["", "é", "İSTANBUL ΟΔΟΣ", "한 각", "́", "áḅ", "\U0001f600x", "ﬁ Å ß"] * 100
    source, target = nz._folding()
    table = {ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)}
    assert nz._folded_texts(texts).to_pylist() == [t.translate(table) for t in texts]


def test_hashes_of_words(spark):
    rng = np.random.default_rng(1)
    texts = ["", "a", "ab", "abc", "abcd", "日本語", *("".join(rng.choice(list("abcé日"), n)) for n in range(1, 40))]
    hashing = HashingTF(numFeatures=1000)
    assert (embedding.murmur3(pa.array(texts)).view(np.int32) % 1000).tolist() == [hashing.indexOf(t) for t in texts]


def test_embedding_is_that_of_spark_ml_from_one_job(spark):
    """The fits of Spark ML went through the lines for the frequencies, the mean and the products."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], rng.integers(1, 12), p=np.arange(60, 0, -1) / 1830)) for _ in range(300)]
    df = checkpointed(spark.createDataFrame([(" ".join(["w0"] * 5000),), *((t,) for t in texts)], "norm string").repartition(3))
    once = df.withColumn("w", words(F.col("norm")))
    stages = [HashingTF(inputCol="w", outputCol="tf", numFeatures=64), IDF(inputCol="tf", outputCol="idf"), PCA(k=3, inputCol="idf", outputCol="pca")]
    want = {r[0]: r[1] for r in Pipeline(stages=stages).fit(once).transform(once).select("norm", vector_to_array("pca")).collect()}
    found = []
    assert jobs_of(spark, "embedding", lambda: found.append(embedding.embedded(df, 64, 3))) <= 2
    for r in found[0].collect():
        assert np.abs(r["vec"]) == pytest.approx(np.abs(want[r["norm"]]), rel=1e-6, abs=1e-6)


def test_score_families_are_sorted_once(spark):
    rng = np.random.default_rng(2)
    lists = [None, [], [1.0], [None, 2.0], [3.0, None, 5.0, 4.0], *(rng.random(n).tolist() for n in range(1, 40))]
    df = spark.createDataFrame([(i, x, x and x[::-1]) for i, x in enumerate(lists)], "i int, errors array<double>, probs array<double>")
    ks = (1, 2, 10)
    kinds = (("error", "errors", "topk_mean"), ("prob", "probs", "bottomk_mean"), ("probtopk", "probs", "topk_mean"))
    old = F.array(*[F.struct(F.lit(k).alias("k"), *[scoring.pool(F.col(c), mode, k).alias(n) for n, c, mode in kinds]) for k in ks])
    both = df.select(old.alias("want"), surprise.top_k_families(ks).alias("got"))
    assert both.schema["got"].dataType.simpleString() == both.schema["want"].dataType.simpleString()
    assert "sort_array" not in df.select(surprise.top_k_families(ks))._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["want"] == r["got"] for r in both.collect())


def test_quality_by_k_makes_one_curve(spark, tmp_path, monkeypatch):
    texts = [(i, f"alpha beta {'xyz'[i % 3]}\nbeta {'abcdefgh'[i % 8]} gamma {i}", "s") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made, curve = [], classify.curve
    monkeypatch.setattr(classify, "curve", lambda *a, **b: made.append(1) or curve(*a, **b))
    got = QUERIES["surprise_quality_by_k"].run(spark, str(tmp_path)).collect()
    assert len(made) == 1 and len(got) == 12 and all(0 <= r["auroc"] <= 1 for r in got)
