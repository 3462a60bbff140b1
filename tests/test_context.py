"""Memory distances, reference sets and tail fits against plain NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omenlog.operators import context, evt, moments, reference
from omenlog.operators.order import Order

CAPACITY, LEAST, REFRESH = 12, 5, 8


def table(n=90, d=4, seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "line_id": np.arange(n), "us": rng.permutation(n),
        "key": np.where(rng.random(n) < 0.5, 0, rng.integers(0, 3, n)),
        "vec": list(rng.normal(size=(n, d))), "label": (rng.random(n) < 0.3).astype(int),
    })


@pytest.fixture(scope="module")
def pdf():
    return table()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf.assign(vec=pdf["vec"].map(list)))


def sessions(pdf, keys):
    parts = [g for _, g in pdf.groupby("key")] if keys else [pdf]
    return [g.sort_values(["us", "line_id"]) for g in parts]


def compare(out, want):
    got = dict(zip(out["line_id"], out["distance"]))
    assert got.keys() == want.keys()
    for k, v in want.items():
        if v is None:
            assert got[k] is None or math.isnan(got[k])
        else:
            assert got[k] == pytest.approx(v, abs=1e-8)


LAYOUTS = [(keys, ranges, block) for keys in ((), ("key",)) for ranges, block in ((9, 16), (1, 8192))]


@pytest.mark.parametrize("keys,ranges,block", LAYOUTS)
def test_cosine_and_knn(df, pdf, keys, ranges, block):
    cos, near = {}, {}
    for g in sessions(pdf, keys):
        x = np.stack(g["vec"])
        for i, line in enumerate(g["line_id"]):
            memory = x[max(0, i - CAPACITY):i]
            cos[line] = None
            near[line] = None
            if len(memory) >= LEAST:
                m = memory.mean(axis=0)
                cos[line] = 1 - x[i] @ m / np.linalg.norm(x[i]) / np.linalg.norm(m)
            if len(memory) >= 3:
                near[line] = np.sort(np.linalg.norm(memory - x[i], axis=1))[:3].mean()
    order = Order(keys, ranges=ranges)
    compare(context.cosine(df, CAPACITY, LEAST, order=order, block_rows=block).toPandas(), cos)
    compare(context.knn(df, CAPACITY, 3, order=order, block_rows=block).toPandas(), near)


@pytest.mark.parametrize("keys,ranges,block", LAYOUTS)
def test_mahalanobis_with_renewed_inverse(df, pdf, keys, ranges, block):
    want = {}
    for g in sessions(pdf, keys):
        x, inverse, pushed, valid = np.stack(g["vec"]), None, 0, False
        for i, line in enumerate(g["line_id"]):
            memory = x[max(0, i - CAPACITY):i]
            if len(memory) < LEAST:
                want[line] = 0.0
            else:
                if not valid:
                    inverse, valid = context.shrunk_inverse(memory), True
                gap = x[i] - memory.mean(axis=0)
                want[line] = math.sqrt(max(0.0, gap @ inverse @ gap))
            pushed += 1
            if pushed >= REFRESH:
                pushed, valid = 0, False
    out = context.mahalanobis(
        df, CAPACITY, LEAST, REFRESH, order=Order(keys, ranges=ranges), not_ready=0.0, block_rows=block
    )
    compare(out.toPandas(), want)


def test_memory_statistics_follow_eviction(df, pdf):
    out = context.memory_statistics(df, CAPACITY, order=Order(ranges=9), block_rows=16).toPandas()
    out = out.set_index("line_id")
    g = sessions(pdf, ())[0]
    x = np.stack(g["vec"])
    for i, line in enumerate(g["line_id"]):
        memory = x[max(0, i - CAPACITY):i]
        row = out.loc[line]
        assert row["n"] == len(memory)
        if len(memory) > 1:
            np.testing.assert_allclose(row["mean"], memory.mean(axis=0))
            assert row["total_variance"] == pytest.approx(memory.var(axis=0, ddof=1).sum())


def test_zero_vector_has_distance_one(spark):
    rows = [(i, i, [1.0, 0.0]) for i in range(6)] + [(6, 6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "line_id long, us long, vec array<double>")
    out = context.cosine(df, 10, 5).orderBy("line_id").collect()
    assert out[-1].distance == 1.0 and out[0].distance is None


def test_reduced_knn_is_exact_when_all_components_are_kept(df):
    plain = context.knn(df, CAPACITY, 3).orderBy("line_id").toPandas()
    small = context.knn(df, CAPACITY, 3, pca=4, min_samples=6).orderBy("line_id").toPandas()
    np.testing.assert_allclose(plain["distance"], small["distance"], atol=1e-8)


@pytest.mark.parametrize("ranges,block", [(9, 16), (1, 8192)])
def test_reduced_knn_is_fitted_on_the_session_itself(df, pdf, ranges, block):
    order, want = Order(("key",), ranges=ranges), {}
    for g in sessions(pdf, ("key",)):
        x = np.stack(g["vec"])
        first = x[:6]
        axes = np.linalg.svd(first - first.mean(axis=0), full_matrices=False)[2][:2]
        for i, line in enumerate(g["line_id"]):
            y = x if i < 6 else x @ axes.T
            memory = y[max(0, i - CAPACITY):i]
            want[line] = np.sort(np.linalg.norm(memory - y[i], axis=1))[:3].mean() if len(memory) >= 3 else None
    out = context.knn(df, CAPACITY, 3, pca=2, min_samples=6, order=order, block_rows=block)
    compare(out.toPandas(), want)


def test_shrinkage_rule():
    assert context.shrinkage(3, 10, 1.0) == 0.5
    assert context.shrinkage(30, 10, 1.0) == pytest.approx(0.1)
    assert context.shrinkage(30, 10, 1.0, 0.3) == 0.3


def test_similarity_margin(df, pdf):
    g = sessions(pdf, ())[0].reset_index(drop=True)
    got = context.similarity_margin(df, rows=7, normals=4, order=Order(ranges=9), block_rows=16).first()
    draw = df.filter("label = 0").orderBy(F.md5(F.col("line_id").cast("string")), "line_id").limit(4).collect()
    normals = np.array([r["vec"] for r in draw])
    x, losses = np.stack(g["vec"]), []
    for i in np.flatnonzero(g["label"] == 1):
        early = x[max(0, i - 7):i]
        if len(early):
            cos = early @ x[i] / np.linalg.norm(early, axis=1) / np.linalg.norm(x[i])
            losses.append(np.maximum(0, 0.5 - cos + (early @ normals.T).mean(axis=1)).mean())
    assert got.failures == len(losses)
    assert got.margin == pytest.approx(np.mean(losses))


@pytest.mark.parametrize("estimator", ["oas", "ledoit_wolf", "ridge"])
@pytest.mark.parametrize("components", [None, 2])
def test_reference_distance(df, pdf, estimator, components):
    x = np.stack(pdf["vec"])
    n = len(x)
    gap = x - x.mean(axis=0)
    if components:
        gap = gap @ np.linalg.svd(gap, full_matrices=False)[2][:components].T
    s, p = gap.T @ gap / n, gap.shape[1]
    mu = np.trace(s) / p
    if estimator == "ridge":
        cov = s + 1e-4 * np.eye(p)
    else:
        if estimator == "oas":
            a = (s**2).mean()
            weight = min((a + mu**2) / ((n + 1) * (a - mu**2 / p)), 1.0)
        else:
            delta = ((s - mu * np.eye(p)) ** 2).sum()
            beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in gap) / n**2
            weight = min(beta, delta) / delta
        cov = (1 - weight) * s + weight * mu * np.eye(p)
    want = np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    fitted = reference.fit(df, components=components, estimator=estimator)
    got = df.select("line_id", fitted.distance("vec").alias("d")).orderBy("line_id").toPandas()["d"]
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_tail_fit_recovers_the_distribution(spark):
    rng = np.random.default_rng(4)
    xi, sigma = 0.2, 3.0
    scores = sigma / xi * (rng.random(60_000) ** -xi - 1)
    df = spark.createDataFrame(pd.DataFrame({"score": scores}))
    row = evt.fit(df, 0.9, 0.001).first()
    y = scores[scores > row.u] - row.u

    def loss(a, b):
        return np.log(b) + (1 + 1 / a) * np.log1p(a * y / b).mean()

    assert row.xi == pytest.approx(xi, abs=0.05)
    best = loss(row.xi, row.sigma)
    for da, db in ((0.01, 0), (-0.01, 0), (0, 0.03), (0, -0.03)):
        assert best <= loss(row.xi + da, row.sigma + db)
    assert row.threshold == pytest.approx(row.u + row.sigma / row.xi * ((row.n / row.k * 0.001) ** -row.xi - 1))


def test_tail_fit_falls_back_with_few_exceedances(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "score double")
    row = evt.fit(df).first()
    assert (row.xi, row.sigma) == (0.0, 1.0)
    assert row.threshold == pytest.approx(np.quantile(np.arange(20), 0.999))


def far_away(n=400, d=3, at=1e6, seed=5):
    """Vectors around a mean far from zero, in doubles as they are."""
    x = np.random.default_rng(seed).normal(size=(n, d)) * [1.0, 0.99, 2.0] + at
    return x, pd.DataFrame({"line_id": np.arange(n), "us": np.arange(n), "key": np.arange(n) % 2, "vec": x.tolist()})


def exact_covariance(x):
    y = (x - x[0]).astype(np.longdouble)
    y = y - y.mean(axis=0)
    return (y.T @ y / (len(x) - 1)).astype(float)


@pytest.mark.parametrize("cell", [1 << 19, 24])
def test_covariance_far_from_zero(spark, monkeypatch, cell):
    """Several tasks, and cells of the whole matrix or of one row of it."""
    monkeypatch.setattr(moments, "CELL_BYTES", cell)
    x, rows = far_away()
    df = spark.createDataFrame(rows).repartition(7).union(spark.createDataFrame([(-1, -1, 0, None)], "line_id long, us long, key long, vec array<double>"))
    got = reference.covariance(df).toPandas().pivot(index="i", columns="j", values="cov").to_numpy()
    np.testing.assert_allclose(got, exact_covariance(x), rtol=1e-9, atol=1e-9)
    n, mean, _ = moments.whole(moments.co_moments(df))
    assert n == len(x)
    np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-12)


def test_covariance_of_no_row_and_of_one(spark):
    schema = "vec array<double>"
    assert reference.covariance(spark.createDataFrame([], schema)).count() == 0
    one = reference.covariance(spark.createDataFrame([([1.0, 2.0],)], schema)).collect()
    assert sorted((r.i, r.j, r.cov) for r in one) == [(i, j, None) for i in (0, 1) for j in (0, 1)]


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_memory_statistics_far_from_zero(spark, keys):
    x, rows = far_away()
    df = spark.createDataFrame(rows)
    out = context.memory_statistics(df, CAPACITY, order=Order(keys, ranges=5), block_rows=64).toPandas().set_index("line_id")
    for g in sessions(rows, keys):
        lines = g["line_id"].to_numpy()
        for i, line in enumerate(lines):
            memory = x[lines[max(0, i - CAPACITY):i]]
            if len(memory) > 1:
                np.testing.assert_allclose(out.loc[line, "mean"], memory.mean(axis=0), rtol=1e-12)
                assert out.loc[line, "total_variance"] == pytest.approx(np.trace(exact_covariance(memory)), rel=1e-9)


def test_window_moments_after_a_jump():
    """Rows of another size that have left the window leave nothing behind."""
    x = np.concatenate([np.full((20, 2), 1e9), np.random.default_rng(1).normal(size=(60, 2))])
    rows = np.arange(len(x))
    size, mean, scatter = moments.window_moments(x, rows, 7, rows)
    for i in rows:
        memory = x[max(0, i - 7):i]
        assert size[i] == len(memory)
        if len(memory):
            np.testing.assert_allclose(mean[i], memory.mean(axis=0), rtol=1e-12)
            want = ((memory - memory.mean(axis=0)) ** 2).sum()
            assert scatter[i] == pytest.approx(want, rel=1e-9, abs=1e-9)
