from itertools import combinations

import numpy as np
import pytest
import xxhash

from omenlog.llm import simhash
from omenlog.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=3):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if bin(a ^ b).count("1") <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def same_partition(a, b):
    return len(set(a.values())) == len(set(b.values())) == len({(a[k], b[k]) for k in a})


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "a b", "A b C", "ÄÖ äö É é x y z", "x\x0by\x0cz\rw", "the cat sat on the mat " * 40, "w " * 70_000,
])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(map(str, np.random.default_rng(0).integers(0, 50, 500)))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    top, second = simhash.families()
    for bits in combinations(range(64), 3):
        differing = sum(1 << b for b in bits)
        clear = [t for t, m in enumerate(top) if not m & differing]
        assert clear
        for t in clear[:1]:
            assert any(not m & differing for m in second[t])
    assert all(not m & top[t] for t, masks in enumerate(second) for m in masks)


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bucket):
    draw = np.random.default_rng(5)
    prints = [0, 7, (1 << 64) - 1]
    for _ in range(30):
        x = int(draw.integers(0, 1 << 63)) * 2 + 1
        for _ in range(12):
            prints.append(x)
            for b in draw.choice(64, int(draw.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    found = simhash.classes(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    got = {int(np.int64(r["fp"]).view(np.uint64)): r["root"] for r in found}
    assert same_partition(got, plain_classes(prints))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    return [
        (5, base, "a"), (3, base, "b"), (9, base + "lambda", "c"), (7, "something else entirely here", "d"), (1, None, "e"),
        (2, "", None), (4, " \n", "f"), (None, base, "g"), (None, "lonely words without any number", "h"), (8, "word", "i"), (8, "word", "i"),
    ]


def test_near_duplicates(spark):
    rows = documents()
    table = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(table)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "n_same"]
    got = sorted(map(tuple, got.collect()), key=str)
    prints = {t: plain_fingerprint(t) for _, t, _ in rows}
    classes = plain_classes(prints.values())
    least = {}
    for i, t, _ in rows:
        c = classes[prints[t]]
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    same = lambda t: sum(prints[u] == prints[t] for _, u, _ in rows)
    assert got == sorted([(i, f"{prints[t]:016x}", least[classes[prints[t]]], same(t)) for i, t, _ in rows], key=str)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = documents()
    table = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    kept = simhash.one_per_component(table)
    assert kept.columns == table.columns
    got = kept.collect()
    classes = plain_classes([plain_fingerprint(t) for _, t, _ in rows])
    assert sorted(classes[plain_fingerprint(r["text"])] for r in got) == sorted(set(classes.values()))
    assert {r["doc_id"] for r in got} >= {1, 3, 7, 8}
    assert simhash.one_per_component(table.limit(0)).count() == 0
