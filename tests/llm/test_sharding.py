import zlib
from collections import defaultdict

import numpy as np
import pytest

from omenlog.llm import sharding


def plain(sizes, shards):
    loads = [0] * shards
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return sorted(loads)


def test_longest_first():
    sizes = np.random.default_rng(0).integers(1, 1000, 300).tolist()
    placed = sharding.longest_first(sizes, 16)
    loads = [sum(n for n, s in zip(sizes, placed) if s == k) for k in range(16)]
    assert sorted(loads) == plain(sizes, 16)


def documents(draw, n):
    texts = ["hot text" * 3] * (n // 3) + ["".join(draw.choice(list("abé "), draw.integers(0, 900))) for _ in range(n - n // 3)]
    return [(i, t) for i, t in enumerate(texts)]


def check(got, rows, shards):
    assert len(got) == len(rows)
    of = defaultdict(set)
    for r in got.itertuples():
        of[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"], got["text_crc32"])) == want
    assert set(got["shard"]) <= set(range(shards)) and got["grown_shard"].isna().all() and set(got["law"]) <= {"bytes"}


@pytest.mark.parametrize("grain", [1 << 16, 256])
def test_shards_are_even_and_groups_stay_together(spark, monkeypatch, grain):
    monkeypatch.setattr(sharding, "GRAIN", grain)
    rows = documents(np.random.default_rng(1), 900)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(table).toPandas()
    check(got, rows, 16)
    loads = got.groupby("shard")["size"].sum()
    groups = defaultdict(int)
    for _, t in rows:
        groups[t] += len(t.encode()) + 1
    best = plain(groups.values(), 16)
    assert len(loads) == 16 and loads.max() - loads.min() <= best[-1] - best[0] + 4 * sum(groups.values()) / grain
    if grain > len(rows) * 60:
        assert sorted(loads) == best


def test_odd_rows(spark):
    rows = [(None, "a"), (1, None), (2, ""), (1, "a"), (1, "a"), (3, "x" * 200_000)]
    table = spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, shard int, grp string")
    got = sharding.shard(table)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(got.toPandas(), rows, 16)
    assert sharding.shard(table.limit(0)).count() == 0
