"""Mixing sources to target weights by Pfair scheduling (earliest deadline first over blocks)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.llm.common import local, numbered, small
from omenlog.session import checkpointed


#: Columns of the answer; columns of the input with these names are replaced.
ADDED = ("mix_source", "mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def quantised(weights: Mapping[int, float], slots: int) -> dict[int, int]:
    """Whole slots per period for each source, at least one each, by largest remainder."""
    total = sum(weights.values())
    free = slots - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = slots - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        out[s] += 1
    return out


def period(shares: Mapping[int, int], slots: int) -> list[tuple[int, int, int, int, int]]:
    """One period: (source, nth block, release, deadline, slot), by earliest deadline first.

    Block i of a source with k of ``slots`` slots is released at floor(i * slots / k) and due at
    ceil((i + 1) * slots / k).  The shares add up to the period, so every block meets its deadline
    and no source is ever a whole block ahead of or behind its share.
    """
    def window(s: int, i: int) -> tuple[int, int]:
        k = shares[s]
        return i * slots // k, -(-(i + 1) * slots // k)

    coming = [(0, s, 0) for s in sorted(shares)]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(slots):
        while coming and coming[0][0] <= slot:
            release, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (window(s, i)[1], s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        out.append((s, i, release, deadline, slot))
        if i + 1 < shares[s]:
            heapq.heappush(coming, (window(s, i + 1)[0], s, i + 1))
    return out


def schedule(blocks: Mapping[int, int], weights: Mapping[int, float], slots: int) -> list[dict]:
    """Phases until all blocks are placed: a phase ends with the last block of some source.

    Each phase has the shares of the sources that still have blocks, the number of blocks placed
    before it (in all and by source) and its period.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    phases, base = [], 0
    while left:
        active = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or {s: float(left[s]) for s in left}
        shares = quantised(active, slots)
        rows = period(shares, slots)
        at = {(s, i): slot for s, i, _, _, slot in rows}
        ends = {s: (left[s] - 1) // k * slots + at[s, (left[s] - 1) % k] for s, k in shares.items()}
        last = min(ends, key=ends.get)
        full, part = divmod(ends[last] + 1, slots)
        phases.append({"base": base, "shares": shares, "first": {s: done[s] for s in shares}, "rows": rows, "last": last})
        for s, k in shares.items():
            used = full * k + sum(1 for x in rows[:part] if x[0] == s)
            done[s] += used
            left[s] -= used
        left = {s: n for s, n in left.items() if n > 0}
        base += ends[last] + 1
    return phases


#: Slots that are scheduled at a time, at least.
STRETCH = 1024

#: (source, weight) in whole numbers, exactly in the proportion of the target weights.
Exact = tuple[tuple[int, int], ...]


def whole(weights: Mapping[int, float]) -> Exact:
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return tuple(sorted((s, int(w * scale)) for s, w in exact.items()))


def window(weights: Exact, s: int, i: int) -> tuple[int, int]:
    """Release and deadline of block i of a source; inside it the source is less than a block off."""
    k, n = dict(weights)[s], sum(k for _, k in weights)
    return i * n // k, -(-(i + 1) * n // k)


@lru_cache(256)
def done(weights: Exact, t: int) -> dict[int, int]:
    """How many blocks of each source the first t slots hold, from t alone.

    Each source has its target rounded down, and some have one block more: by earliest deadline,
    as long as the blocks released at slot a or later are at most t - a, for every a.  So all
    slots up to t can be filled in time, and all slots after it.
    """
    n = sum(k for _, k in weights)
    out = {s: t * k // n for s, k in weights}
    rest = t - sum(out.values())
    back = min(t, -(-n // min(k for _, k in weights)) + 1)
    late = np.zeros(back, np.int64)
    for s, k in weights:
        for i in range(-(-(t - back) * k // n), out[s]):
            late[i * n // k - (t - back)] += 1
    room = np.arange(back, 0, -1) - late[::-1].cumsum()[::-1]
    begun = sorted((-(-(out[s] + 1) * n // k), s, out[s] * n // k) for s, k in weights if t * k % n)
    for _, s, release in begun:
        until = release - (t - back) + 1
        if rest and room[:until].min() > 0:
            room[:until] -= 1
            out[s] += 1
            rest -= 1
    return out


@lru_cache(32)
def stretch(weights: Exact, slots: int, p: int) -> dict[int, tuple[int, np.ndarray]]:
    """Slots p * slots .. (p + 1) * slots: each source's first block there, and the slots of its blocks."""
    start, end = p * slots, (p + 1) * slots
    first, until = done(weights, start), done(weights, end)
    n, share = sum(k for _, k in weights), dict(weights)
    coming = [(max(start, first[s] * n // k), s, first[s]) for s, k in weights if first[s] < until[s]]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    out: dict[int, list[int]] = {s: [] for s in first}
    for slot in range(start, end):
        while coming and coming[0][0] <= slot:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (min(end, -(-(i + 1) * n // share[s])), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        if i + 1 < until[s]:
            heapq.heappush(coming, (max(slot + 1, (i + 1) * n // share[s]), s, i + 1))
    return {s: (first[s], np.array(x, dtype=np.int64)) for s, x in out.items()}


def slot_of(weights: Exact, slots: int, s: int, i: int) -> int:
    p = window(weights, s, i)[0] // slots
    while done(weights, (p + 1) * slots)[s] <= i:
        p += 1
    first, places = stretch(weights, slots, p)[s]
    return int(places[i - first])


def exact_schedule(blocks: Mapping[int, int], weights: Mapping[int, float], least: int = STRETCH) -> list[dict]:
    """Phases like those of ``schedule``, with exact weights instead of the slots of a period.

    A stretch has so many slots that every source has a block in it: then the stretches can be
    scheduled one by one.  The driver schedules those in which sources end.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    so_far = dict.fromkeys(left, 0)
    phases, base = [], 0
    while left:
        active = whole({s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or {s: float(n) for s, n in left.items()})
        n = sum(k for _, k in active)
        slots = min(max(least, -(-n // min(k for _, k in active))), sum(left.values()))
        windows = {s: window(active, s, left[s] - 1) for s, _ in active}
        soon = min(due for _, due in windows.values())
        ends = {s: slot_of(active, slots, s, left[s] - 1) for s, (release, _) in windows.items() if release < soon}
        last = min(ends, key=ends.get)
        phases.append({
            "base": base, "weights": active, "slots": slots, "first": {s: so_far[s] for s, _ in active}, "last": last,
        })
        for s, (first, places) in stretch(active, slots, ends[last] // slots).items():
            used = first + int(np.searchsorted(places, ends[last], "right"))
            so_far[s] += used
            left[s] -= used
        left = {s: n for s, n in left.items() if n > 0}
        base += ends[last] + 1
    return phases


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, temper: float = 0.5,
    block_rows: int = 8, slots: int | None = None, source: str | Column = "source",
) -> DataFrame:
    """All columns of ``docs`` plus ``mix_source`` .. ``mix_position``; every row stays, once.

    The rows of a source are cut into blocks of ``block_rows`` in table order.  Target weights
    are given by source or, by default, proportional to rows ** ``temper``.  Blocks have their
    windows from the exact weights and are scheduled earliest deadline first, in stretches that
    every task can schedule for the rows it has, as the blocks done before a stretch follow from
    its number alone.  When a source runs out, the others go on by their weights in a new phase.
    In every prefix of a phase each source is less than one block away from its target.

    With ``slots`` the weights become whole numbers of slots of a period that is repeated (8 slots
    per source at least): shares are then those rounded ones, not the target.

    A null source is a source.  Sources of weight 0 or without a weight follow after the others,
    in proportion to their size.  Null ids, texts and repeated rows are ordinary rows; an empty
    table gives an empty result.  Added: mix_source, mix_block, mix_phase, mix_release,
    mix_deadline (in slots of the whole schedule), mix_slot, mix_position (gapless from 0).
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    keyed = docs.select(whole.alias("doc"), (F.col(source) if isinstance(source, str) else source).alias("mix_source"))
    rows = numbered(keyed, "mix_source", "_row")
    sizes = rows.groupBy("mix_source").agg(F.count("*").alias("n")).collect()
    names = sorted((r["mix_source"] for r in sizes), key=lambda s: (s is not None, s))
    count = {names.index(r["mix_source"]): r["n"] for r in sizes}
    if weights is None:
        wanted = {i: n**temper for i, n in count.items()}
    else:
        wanted = {i: float(weights.get(names[i], 0) or 0) for i in count}
    blocks = {i: -(-n // block_rows) for i, n in count.items()}
    if slots is None:
        return placed_exactly(rows, names, count, exact_schedule(blocks, wanted), block_rows)
    phases = schedule(blocks, wanted, max(slots, 8 * len(names)))
    return placed(rows, names, count, phases, block_rows, max(slots, 8 * len(names)))


def placed_exactly(rows: DataFrame, names: list, count: dict, phases: list[dict], block_rows: int) -> DataFrame:
    """Each numbered row with its block's window and slot and its own position."""
    number = local(rows.sparkSession, {"_name": names, "_src": list(range(len(names)))}, "_name string, _src long")
    shorts = np.cumsum([0, *(-count[phase["last"]] % block_rows for phase in phases)]).tolist()
    fields = ("phase", "release", "deadline", "slot", "short")

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        spans = {
            s: [(p, phase["first"][s]) for p, phase in enumerate(phases) if s in phase["first"]] for s in range(len(names))
        }
        for sources, blocks in batches:
            pairs, at = np.unique(np.stack([sources.to_numpy(), blocks.to_numpy()]), axis=1, return_inverse=True)
            found = np.zeros((pairs.shape[1], len(fields)), dtype=np.int64)
            for x, (s, block) in enumerate(pairs.T.tolist()):
                p, first = next(span for span in reversed(spans[s]) if span[1] <= block)
                phase = phases[p]
                release, due = window(phase["weights"], s, block - first)
                slot = slot_of(phase["weights"], phase["slots"], s, block - first)
                found[x] = p, *(phase["base"] + v for v in (release, due, slot)), shorts[p]
            yield pd.DataFrame(found[at.ravel()], columns=list(fields))

    at = F.pandas_udf(each, ", ".join(f"{f} long" for f in fields))(F.col("_src"), F.col("mix_block"))
    out = (
        rows.withColumn("mix_block", F.floor(F.col("_row") / block_rows))
        .join(small(number, len(names)), F.col("mix_source").cast("string").eqNullSafe(F.col("_name")))
        .withColumn("_at", at)
    )
    added = {
        "mix_phase": F.col("_at.phase"), "mix_release": F.col("_at.release"), "mix_deadline": F.col("_at.deadline"),
        "mix_slot": F.col("_at.slot"),
        "mix_position": F.col("_at.slot") * block_rows + F.col("_row") % block_rows - F.col("_at.short"),
    }
    return out.select("doc.*", "mix_source", "mix_block", *[v.cast("long").alias(k) for k, v in added.items()])


def placed(rows: DataFrame, names: list, count: dict, phases: list[dict], block_rows: int, slots: int) -> DataFrame:
    """Each numbered row with its block's window and slot and its own position."""
    spark = rows.sparkSession
    spans = {k: [] for k in ("_src", "_phase", "_first", "_until", "_share", "_base", "_short")}
    places = {k: [] for k in ("_sp", "_nth", "_rel", "_due", "_slot")}
    short = 0
    for p, phase in enumerate(phases):
        after = phases[p + 1]["first"] if p + 1 < len(phases) else {}
        code_of = {}
        for s, k in phase["shares"].items():
            spans["_src"].append(s)
            spans["_phase"].append(p)
            spans["_first"].append(phase["first"][s])
            spans["_until"].append(after.get(s, 1 << 60))
            spans["_share"].append(k)
            spans["_base"].append(phase["base"])
            spans["_short"].append(short)
            code_of[s] = (p << 32) | s
        for s, i, release, deadline, slot in phase["rows"]:
            for k, v in zip(places, (code_of[s], i, release, deadline, slot)):
                places[k].append(v)
        short += -count[phase["last"]] % block_rows
    span = local(spark, spans, "_src long, _phase long, _first long, _until long, _share long, _base long, _short long")
    place = local(spark, places, "_sp long, _nth long, _rel long, _due long, _slot long")
    number = local(spark, {"_name": names, "_src": list(range(len(names)))}, "_name string, _src long")
    out = (
        rows.withColumn("mix_block", F.floor(F.col("_row") / block_rows))
        .join(small(number, len(names)), F.col("mix_source").cast("string").eqNullSafe(F.col("_name")))
        .join(small(span, len(spans["_src"])), "_src")
        .filter("mix_block >= _first AND mix_block < _until")
        .withColumn("_sp", F.shiftleft("_phase", 32) + F.col("_src"))
        .withColumn("_nth", (F.col("mix_block") - F.col("_first")) % F.col("_share"))
        .withColumn("_turn", F.floor((F.col("mix_block") - F.col("_first")) / F.col("_share")))
        .join(small(place, len(places["_sp"])), ["_sp", "_nth"])
    )
    turn = F.col("_base") + F.col("_turn") * slots
    added = {
        "mix_phase": F.col("_phase"), "mix_release": turn + F.col("_rel"), "mix_deadline": turn + F.col("_due"),
        "mix_slot": turn + F.col("_slot"),
        "mix_position": (turn + F.col("_slot")) * block_rows + F.col("_row") % block_rows - F.col("_short"),
    }
    return out.select("doc.*", "mix_source", "mix_block", *[v.cast("long").alias(k) for k, v in added.items()])
