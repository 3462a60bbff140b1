"""Registered queries that SQL cannot repeat, against plain Python and NumPy on the same tables."""

import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest

from omenlog.functions import normalise as nz
from omenlog.functions.words import PIECES
from omenlog.operators import context
from omenlog.plans import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load()


def read(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def run(spark, name):
    return QUERIES[name].run(spark, FOLDER).toPandas()


@pytest.mark.parametrize("name, table, key, text", [
    ("packed_page_windows", "pages", "page_id", "html"), ("packed_document_windows", "documents", "doc_id", "text"),
])
def test_packed_windows(spark, name, table, key, text):
    want = []
    for owner, value in zip(*(read(table)[c] for c in (key, text))):
        windows, used = [], 0
        for pos, word in enumerate(w for w in re.split(r"\s+", value) if w):
            size = max(1, len(re.findall(PIECES, word)))
            if not windows or used + size > 510:
                windows.append([])
                used = 0
            windows[-1].append(pos)
            used += size
        want += [(owner, i, len(w), w[0], w[-1]) for i, w in enumerate(windows)]
    got = run(spark, name)[["owner", "win", "n_words", "first_pos", "last_pos"]]
    assert sorted(got.itertuples(index=False, name=None)) == want


def test_normalise_bgl(spark):
    docs, want = read("documents"), {}
    for owner, value in zip(docs["doc_id"], docs["text"]):
        for n, line in enumerate(value.split("\n")):
            for pattern, name, _ in nz.BGL_MASKS:
                line = re.sub(pattern, name, line)
            line = unicodedata.normalize("NFD", line.lower())
            line = "".join(c for c in line if unicodedata.category(c) != "Mn")
            line = " ".join(re.sub(r"[^a-zA-Z<>]+", " ", line).strip().split(" ")[3:])
            if line:
                want[(int(owner) << 31) + n] = line
    got = run(spark, "normalise_bgl")
    assert dict(zip(got["line_id"], got["norm"])) == want


def vectors(by=None):
    pdf = read("embeddings").sort_values("vec_id")
    parts = [g for _, g in pdf.groupby(by)] if by else [pdf]
    return [(g["vec_id"].tolist(), np.stack(g["embedding"]).astype(float)) for g in parts]


def close(got, want, missing):
    got = dict(zip(got["line_id"], got["distance"]))
    assert got.keys() == want.keys()
    for line, value in want.items():
        there = missing if got[line] is None or math.isnan(got[line]) else got[line]
        assert there == pytest.approx(missing if value is None else value, rel=1e-6, abs=1e-9)


def test_memory_knn_reduced(spark):
    (lines, x), = vectors()
    axes = np.linalg.svd(x[:17] - x[:17].mean(axis=0), full_matrices=False)[2][:16]
    small, want = x @ axes.T, {}
    for i, line in enumerate(lines):
        y = small if i >= 17 else x
        far = np.sort(np.linalg.norm(y[max(0, i - 128): i] - y[i], axis=1))[:10]
        want[line] = far.mean() if i >= 10 else -1.0
    close(run(spark, "memory_knn_reduced"), want, -1.0)


@pytest.mark.parametrize("name, by, capacity", [
    ("memory_mahalanobis", None, 128), ("memory_mahalanobis_by_session", "label", 32),
    ("stream_memory_mahalanobis", "label", 32),
])
def test_memory_mahalanobis(spark, name, by, capacity):
    want = {}
    for lines, x in vectors(by):
        for i, line in enumerate(lines):
            memory = x[max(0, i - capacity): i]
            if len(memory) < 10:
                want[line] = None
                continue
            renewed = max(10, 128 * (i // 128))
            inverse = context.shrunk_inverse(x[max(0, renewed - capacity): renewed])
            gap = x[i] - memory.mean(axis=0)
            want[line] = math.sqrt(max(0.0, gap @ inverse @ gap))
    close(run(spark, name), want, 0.0)


@pytest.mark.parametrize("name, components, estimator", [
    ("reference_mahalanobis_oas", 32, "oas"), ("reference_mahalanobis_ledoit_wolf", None, "ledoit_wolf"),
    ("memory_slot_mahalanobis", None, "ridge"),
])
def test_reference_distances(spark, name, components, estimator):
    pdf = read("embeddings").sort_values("vec_id")
    x = np.stack(pdf["embedding"]).astype(float)
    own = x[(pdf["label"] != 0).to_numpy()]
    n, mean = len(own), own.mean(axis=0)
    gap, far = own - mean, x - mean
    if components:
        axes = np.linalg.svd(gap, full_matrices=False)[2][:components].T
        gap, far = gap @ axes, far @ axes
    s, p = gap.T @ gap / n, gap.shape[1]
    level = np.trace(s) / p
    if estimator == "ridge":
        cov = s + 1e-4 * np.eye(p)
    else:
        if estimator == "oas":
            square = (s**2).mean()
            weight = min((square + level**2) / ((n + 1) * (square - level**2 / p)), 1.0)
        else:
            delta = ((s - level * np.eye(p)) ** 2).sum()
            beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in gap) / n**2
            weight = min(beta, delta) / delta
        cov = (1 - weight) * s + weight * level * np.eye(p)
    want = np.sqrt(np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far))
    got = run(spark, name).sort_values("line_id")
    assert got["line_id"].tolist() == pdf["vec_id"].tolist()
    assert got["label"].tolist() == (pdf["label"] != 0).astype(int).tolist()
    np.testing.assert_allclose(got["distance"], want, rtol=1e-8)


def test_evt_threshold_leaves_the_risk_above_it(spark):
    events = read("events")
    scores = events[events["event_type"] != "error"]["value"]  # fitted on normal lines
    row = run(spark, "evt_threshold").iloc[0]
    assert row["n"] == len(scores) and row["u"] == pytest.approx(np.quantile(scores, 0.98))
    assert row["k"] == (scores > row["u"]).sum()
    exceeding = (scores[scores > row["u"]] - row["u"]).to_numpy()
    # the fitted pair is at least as likely as any near it
    def loss(xi, sigma):
        z = 1 + xi * exceeding / sigma
        return np.inf if sigma <= 0 or (z <= 0).any() else len(z) * math.log(sigma) + (1 + 1 / xi) * np.log(z).sum()

    best = loss(row["xi"], row["sigma"])
    for dx in (-0.05, 0, 0.05):
        for ds in (0.95, 1, 1.05):
            if abs(row["xi"] + dx) > 1e-6:
                assert loss(row["xi"] + dx, row["sigma"] * ds) >= best - 1e-3 * abs(best)
