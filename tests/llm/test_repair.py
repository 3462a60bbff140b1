import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from omenlog.llm import repair
from omenlog.llm.queries import QUERIES

GOAL = re.compile(r"(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """(conv, turn, role, text) rows after damage, by conversation."""
    blank = lambda v: " " if v is None else str(v)
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = blank(role), blank(text)
        what = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        out[conv] += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired lines): a best-first search over edits, in order of cost, then of the audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(lines)
        if (at, last) in done:
            continue
        done.add((at, last))
        following = "a" if last == "u" else "u"
        full = {"u": "user", "a": "assistant"}[following]
        if audit.count("I") <= 2 * len(rows) + 2:
            heapq.heappush(heap, (cost + 2, audit + "I", at, following, (*lines, f"{full}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, lines))
            if found[at] not in ("blank", "duplicate"):
                more = found[at] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, following, (*lines, f"{full}:{text}")))
                if role[:1] and (role[:1] == following or (role[:1], last) == ("s", "")):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))


def plain(rows):
    """The whole result, one conversation after the other."""
    convs, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = convs.get(conv, [])
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = cheapest(own, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_search_agrees_with_all_ways():
    # The best-first search itself, against every audit of up to four rows.
    for roles in itertools.product(["user", "assistant", "system", " "], repeat=3):
        rows = [(k, r, f"text {k}" + ("." if k % 2 else "")) for k, r in enumerate(roles)]
        found = faults(rows)
        best = None
        for inserts in itertools.product(range(3), repeat=4):
            for edits in itertools.product("DKR", repeat=3):
                audit = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""]))
                cost = 2 * sum(inserts) + sum(
                    {"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == "truncated") for e, f in zip(edits, found))
                if best and (cost, audit) >= best:
                    continue
                states = {""}
                for letter, row in zip(audit, itertools.chain.from_iterable(
                        [*[None] * n, r] for n, r in zip(inserts, [*rows, None]))):
                    moves = {"D": lambda s: {s}, "K": lambda s, row=row: {s + row[1][0]}}.get(letter, lambda s: {s + "u", s + "a"})
                    states = set().union(*[moves(s) for s in states])
                if any(GOAL.fullmatch(s) for s in states):
                    best = cost, audit
        assert cheapest(rows, found)[:2] == best


def random_rows(seed, convs, size):
    draw = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "users"]
    texts = ["Good.", "Why?", "no end", " \t", "", None, "Fine! ", "end  ", "a\nb."]
    out = []
    for conv in [None, *range(convs)]:
        n = int(draw.integers(1, size))
        proper = draw.random() < 0.5
        for k in range(n):
            role = ["user", "assistant"][k % 2] if proper and draw.random() < 0.8 else roles[draw.integers(0, len(roles))]
            text = texts[draw.integers(0, len(texts))] if draw.random() < 0.4 else f"words {draw.integers(0, 3 * n)}."
            out.append((conv, None if draw.random() < 0.05 else int(draw.integers(-3, 2 * n)), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("ranges", [None, 23])
def test_against_search(spark, ranges):
    rows = random_rows(1, 60, 14)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rows_of(repair.summary(table, repair.repair(repair.damaged(table), ranges=ranges)))
    assert got == plain(rows)


@pytest.mark.parametrize("kind, most", [("mixed", 3), ("mixed", 0), ("alternating", 3), ("system", 3), ("equal", 3)])
def test_one_conversation_over_many_stretches(spark, monkeypatch, kind, most):
    draw = np.random.default_rng(7)
    n = 700
    roles = {"mixed": ["user", "assistant", "system", "tool"], "alternating": ["user", "assistant"], "system": ["system"], "equal": ["user"]}[kind]
    rows = [(5, k, roles[draw.integers(0, 4) % len(roles)] if kind == "mixed" else roles[k % len(roles)],
             "the same." if kind == "equal" else f"text {k}" + "." * (k % 3)) for k in range(n)]
    rows += [(6, 0, "user", "short."), (6, 1, "assistant", "yes.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    passes = []
    monkeypatch.setattr(repair, "PASSES", most)
    whole = repair.products
    monkeypatch.setattr(repair, "products", lambda *a, **k: passes.append(k["forward"]) or whole(*a, **k))
    fixed = repair.repair(repair.damaged(table), ranges=16)
    assert fixed.stretches.filter("conv_id = 5").count() > 8
    assert rows_of(repair.summary(table, fixed)) == plain(rows)
    # Mixed rows converge; rows that must all go hand costs on unchanged, so their stretches are multiplied.
    assert passes == ([False, True] if kind == "equal" or not most else [True])


def test_repaired_rows(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(
        [("system", "Be kind."), ("assistant", "Hello."), ("assistant", "Hello."), ("user", "Bye"), ("tool", "9.")])]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", pos int, chunk int")
    got = repair.repaired(repair.repair(table)).orderBy("conv_id", "pos", "step").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in got] == [
        ("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("D", "assistant", "Hello."),
        ("K", "user", "Bye"), ("R", "assistant", "9.")]


def test_odd_tables(spark):
    rows = [(None, None, None, None), (1, 0, "user", "x" * 200_000), (2, 5, "", ""), (3, None, "user", "a."), (3, None, "user", "a.")]
    table = spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", extra string").withColumnRenamed("extra", "a.b")
    assert rows_of(repair.summary(table, repair.repair(repair.damaged(table)))) == plain(rows)
    empty = table.limit(0)
    assert repair.summary(empty, repair.repair(repair.damaged(empty))).count() == 0
    assert repair.repaired(repair.repair(empty)).count() == 0


def test_query(spark, folder):
    table = pd.read_parquet(f"{folder}/conversations.parquet").astype(object)
    rows = list(table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    got = QUERIES["op12_repair"](spark, folder)
    assert got.columns == ["conv_id", *COLUMNS] and rows_of(got) == plain(rows)
