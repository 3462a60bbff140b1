import itertools
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from omenlog.llm import packing
from omenlog.llm.queries import QUERIES, TOKENIZER


def filled(steps, counts, capacity):
    """Sequences as lists of (offset, length), after every item was placed exactly once."""
    seen, out = Counter(), {}
    for length, first, count, base, each, offset in sorted(steps):
        assert first == seen[length] and count > 0
        seen[length] += count
        for k in range(count):
            out.setdefault(base + k // each, []).append((offset + k % each * length, length))
    assert seen == Counter(counts)
    for parts in out.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return out


def best_fit_decreasing(lengths, capacity):
    """Large items matched one by one, then every small item into the smallest gap: free tokens of all sequences."""
    large = sorted(n for n in lengths if 3 * n > capacity)
    gaps = []
    while large:
        a = large.pop()
        fits = [b for b in large if a + b <= capacity]
        if fits:
            large.remove(fits[-1])
        gaps.append(capacity - a - (fits[-1] if fits else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def most_pairs(large, capacity):
    if len(large) < 2:
        return 0
    a, rest = large[0], large[1:]
    return max([most_pairs(rest, capacity)] + [
        1 + most_pairs(rest[:k] + rest[k + 1:], capacity) for k, b in enumerate(rest) if a + b <= capacity])


def fewest(lengths, capacity):
    """The optimum by trying all ways."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[k] <= capacity:
                rest = list(bins)
                rest.remove(b)
                go(k + 1, [*rest, b + lengths[k]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_item_by_item(seed):
    draw = np.random.default_rng(seed)
    capacity = int(draw.integers(3, 60))
    lengths = draw.integers(1, capacity + 1, draw.integers(1, 200)).tolist()
    if seed % 3 == 0:
        lengths = [max(1, n // 4) if k % 5 else n for k, n in enumerate(lengths)]
    counts = Counter(lengths)
    plan = packing.plan(counts, capacity)
    out = filled(plan.steps, counts, capacity)
    assert sorted(out) == list(range(plan.sequences))
    gaps = sorted(capacity - sum(n for _, n in parts) for parts in out.values())
    assert gaps == best_fit_decreasing(lengths, capacity)
    assert packing.least_sequences(counts, capacity) <= len(out)


def test_matching_gives_the_most_pairs():
    draw = np.random.default_rng(1)
    for _ in range(200):
        large = draw.integers(11, 31, draw.integers(0, 8)).tolist()  # above a third of 30
        plan = packing.plan(Counter(large), 30)
        assert plan.sequences == len(large) - most_pairs(large, 30)


def test_close_to_the_optimum():
    draw = np.random.default_rng(2)
    for _ in range(40):
        lengths = sorted(draw.integers(1, 21, 8).tolist(), reverse=True)
        got, best = packing.plan(Counter(lengths), 20).sequences, fewest(lengths, 20)
        assert packing.least_sequences(Counter(lengths), 20) <= best <= got <= best + 1


def test_steps_do_not_grow_with_the_items():
    draw = np.random.default_rng(4)
    few = Counter((draw.lognormal(5.5, 1.2, 50_000).astype(int) % 4096 + 1).tolist())
    many = {n: c * 1_000_000 + 7 for n, c in few.items()}
    plan = packing.plan(many, 4096)
    assert len(plan.steps) < 8 * 4096
    assert plan.sequences <= 1.001 * packing.least_sequences(many, 4096)


def test_placed_rows(spark):
    draw = np.random.default_rng(5)
    lengths = [*draw.integers(1, 101, 400).tolist(), *[30] * 500]  # one length holds half of all rows
    table = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id long, length int, offset string").withColumnRenamed("offset", "a.b").withColumn("Offset", F.lit(1))
    got = packing.placed(table.repartition(7), 100).toPandas()
    assert list(got.columns) == ["id", "length", "a.b", "sequence_id", "offset"]
    assert dict(zip(got["id"], got["length"])) == dict(enumerate(lengths))
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *itertools.accumulate(part["length"])][:-1] and part["length"].sum() <= 100
    assert got["sequence_id"].nunique() == packing.plan(Counter(lengths), 100).sequences
    assert packing.placed(table.limit(0), 100).count() == 0
    for wrong in (0, 101, None):
        with pytest.raises(ValueError):
            packing.placed(spark.createDataFrame([(5,), (wrong,)], "length int"), 100)


def library(texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(got, docs, capacity):
    wanted = Counter()
    for doc, text in docs:
        ids, = library([text or ""])
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    cells = got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)
    assert Counter((None if pd.isna(r[0]) else r[0], *r[1:]) for r in map(tuple, cells)) == wanted
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *itertools.accumulate(part["length"])][:-1] and part["length"].sum() <= capacity


def test_odd_documents(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "so it goes <|endoftext|> ß́  x" * 9), (3, "so it goes"), (4, "word " * 900)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, offset int")
    got = packing.pack(table, TOKENIZER, capacity=100).toPandas()
    check(got, rows, 100)
    assert packing.pack(table.limit(0), TOKENIZER).count() == 0


def test_sequences_hold_the_pieces(spark):
    rows = [(k, f"piece {k} of many " * (k % 23)) for k in range(200)]
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, capacity=128)
    packed = packing.placed(cut, 128).cache()
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    ids = {k: i for (k, _), i in zip(rows, library([t for _, t in rows]))}
    for r in packed.collect():
        at = r["offset"]
        assert whole[r["sequence_id"]][at : at + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))


def test_query(spark, folder):
    got = QUERIES["op11_packing"](spark, folder).toPandas()
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    check(got, list(zip(docs["doc_id"], docs["text"])), 4096)
    counts = Counter(got["length"])
    assert got["sequence_id"].nunique() <= packing.least_sequences(counts, 4096) + 1
