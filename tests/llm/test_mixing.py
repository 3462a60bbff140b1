from collections import Counter
from fractions import Fraction

import pytest

from omenlog.llm import mixing


@pytest.mark.parametrize("weights", [{0: 1}, {0: 1, 1: 1}, {0: 5, 1: 3, 2: 2}, {0: 100, 1: 1, 2: 1, 3: 7}, {i: i + 1 for i in range(20)}])
def test_no_source_is_a_block_off_its_share(weights):
    slots = 256
    shares = mixing.quantised(weights, slots)
    assert sum(shares.values()) == slots and min(shares.values()) >= 1
    rows = mixing.period(shares, slots)
    assert [r[4] for r in rows] == list(range(slots))
    seen = Counter()
    for s, i, release, deadline, slot in rows:
        assert i == seen[s] and release <= slot < deadline
        seen[s] += 1
        for t, k in shares.items():
            assert abs(seen[t] - Fraction(k * (slot + 1), slots)) < 1
    assert seen == shares


def rows(sizes, schema="doc_id long, source string, mix_slot string"):
    return [(i, s, "x") for s, n in sizes for i in range(n)], schema


def check(got, sizes, block, slots, weights=None, temper=0.5):
    """Positions follow the schedule that a walk over all slots gives."""
    assert sorted(got["mix_position"]) == list(range(len(got)))
    names = sorted({s for s, _ in sizes}, key=lambda s: (s is not None, s))
    count = {names.index(s): n for s, n in sizes}
    wanted = {i: n**temper for i, n in count.items()} if weights is None else {i: weights.get(names[i], 0) for i in count}
    left, order = {i: -(-n // block) for i, n in count.items()}, []
    placed = Counter()
    while any(left.values()):
        active = {i: wanted[i] for i, n in left.items() if n and wanted[i] > 0} or {i: float(n) for i, n in left.items() if n}
        period = mixing.period(mixing.quantised(active, slots), slots)
        for step in range(10**6):
            s = period[step % slots][0]
            size = min(block, count[s] - placed[s] * block)
            order += [names[s]] * size
            placed[s] += 1
            left[s] -= 1
            if not left[s]:
                break
    mixed = got.sort_values("mix_position")["source"]
    assert [None if s != s else s for s in mixed] == order


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, None: 0.2}])
def test_mix_places_every_row_once(spark, weights):
    sizes = [("a", 301), ("b", 50), ("c", 7), (None, 23)]
    data, schema = rows(sizes)
    table = spark.createDataFrame(data, schema).repartition(5)
    got = mixing.mix(table, weights, block_rows=4, slots=64)
    assert got.columns[:2] == ["doc_id", "source"]
    got = got.toPandas()
    assert len(got) == len(data) and got["mix_slot"].between(got["mix_release"], got["mix_deadline"] - 1).all()
    assert Counter(zip(got["doc_id"], got["source"].fillna("-"))) == Counter((i, s or "-") for i, s, _ in data)
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    check(got, sizes, 4, 64, weights)


def test_hot_source_repeated_rows_and_empty_table(spark):
    table = spark.createDataFrame([(1, "hot", None)] * 400 + [(None, "cold", "y")] * 3, "doc_id long, source string, mix_slot string")
    got = mixing.mix(table, block_rows=8, slots=32).toPandas()
    check(got, [("cold", 3), ("hot", 400)], 8, 32)
    assert mixing.mix(table.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [
    dict.fromkeys(range(20), 1.0), {0: 1}, {0: 0.7, 1: 0.1, 2: 0.1, 3: 0.1}, {0: 1000.0, 1: 1.0, 2: 1.0, 3: 37.5},
    {i: (i * 7919 % 97 + 1) ** 0.5 for i in range(30)}, {0: 2**0.5, 1: 3**0.5, 2: 0.003, 3: 0.003}, {i: 3.0**-i for i in range(7)},
])
def test_exact_weights_over_many_stretches(weights):
    """No source is a block off its true target weight after any number of blocks."""
    exact = mixing.whole(weights)
    total = sum(Fraction(w) for w in weights.values())
    slots = max(64, -int(-total // min(Fraction(w) for w in weights.values())))
    slot_of, seen = {}, Counter()
    for p in range(max(20, 20_000 // slots)):
        for s, (first, places) in mixing.stretch(exact, slots, p).items():
            assert first == seen[s]
            for i, slot in enumerate(places.tolist(), first):
                release, due = mixing.window(exact, s, i)
                assert release <= slot < due and slot not in slot_of
                slot_of[slot] = s
            seen[s] += len(places)
    assert sorted(slot_of) == list(range(len(slot_of)))
    seen = Counter()
    for slot in range(len(slot_of)):
        seen[slot_of[slot]] += 1
        if slot % 7 == 0:
            assert all(abs(seen[s] - (slot + 1) * Fraction(w) / total) < 1 for s, w in weights.items())


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.11, None: 0.09}])
def test_rows_follow_the_target_weights(spark, weights):
    sizes = [("a", 40_001), ("b", 30_000), ("c", 19_999), (None, 9_003), ("d", 5)]
    data, schema = rows(sizes)
    got = mixing.mix(spark.createDataFrame(data, schema).repartition(5), weights, block_rows=1).toPandas()
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    got = got.sort_values("mix_position")
    assert len(got) == len(data) and got["mix_position"].tolist() == list(range(len(got)))
    assert Counter(zip(got["doc_id"], got["source"])) == Counter((i, s) for i, s, _ in data)
    assert got["mix_slot"].between(got["mix_release"], got["mix_deadline"] - 1).all()
    target = {s: n**0.5 for s, n in sizes} if weights is None else weights
    left, walk = Counter(dict(sizes)), got["source"].tolist()
    at = 0
    while at < len(walk):  # a phase: until some source has no rows left
        active = {s: Fraction(target.get(s, 0)) for s, n in left.items() if n and target.get(s)} or {s: Fraction(n) for s, n in left.items() if n}
        total, seen = sum(active.values()), Counter()
        while all(left[s] for s in active):
            seen[walk[at]] += 1
            left[walk[at]] -= 1
            at += 1
            assert all(abs(seen[s] - at_phase * w / total) < 1 for at_phase in [sum(seen.values())] for s, w in active.items())
