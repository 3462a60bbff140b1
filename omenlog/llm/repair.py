"""Repair of conversations at least cost: rank-convergence parallel Viterbi over stretches of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.operators.order import Order, laid_out, ordinal
from omenlog.session import checkpointed

#: States: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant message, which the state before it determines.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A row's code: the role's initial (0 none of them, else its state), 4 if truncated, 8 if it must go.
TRUNCATED, FORCED = 4, 8
FAR = 1 << 20
#: Costs to the end once all rows are behind, by state.
END = (0, 2 * INSERT, INSERT, 0)
#: Speculative costs at the end of a stretch that others follow.
GUESS = (0, 0, 0, 0)
#: Passes of the fix-up; stretches that still change are then solved for all inputs at once.
PASSES = 6

SPACE = " \t\n\x0b\x0c\r"
_CHUNK = "conv_id {0}, chunk int, codes array<tinyint>, last boolean"


def _kept(state: int, code: int) -> int | None:
    """The state after keeping the row, or None."""
    initial = code & 3
    if initial == SYSTEM:
        return SYSTEM if state == NOTHING else None
    return initial if initial and NEXT[state] == initial else None


@cache
def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their least one, and that least one."""
    base = []
    for state, cost in enumerate(after):
        ways = [DELETE + cost]
        if not code & FORCED:
            cut = CUT if code & TRUNCATED else 0
            ways.append(REROLE + cut + after[NEXT[state]])
            if (kept := _kept(state, code)) is not None:
                ways.append(cut + after[kept])
        base.append(min(ways))
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    costs = (min(base[NOTHING], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant)
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


@cache
def choice(after: tuple[int, ...], code: int, state: int) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits up to and with a row, the state then and their cost."""
    before, least = step(after, code)
    edits, cost = "", 0
    while True:
        open_ = before[state] + least
        cut = CUT if code & TRUNCATED else 0
        if DELETE + after[state] == open_:
            return edits + "D", state, cost + DELETE
        to = NEXT[state]
        if INSERT + before[to] + least == open_:
            edits, state, cost = edits + "I" + ROLES[to][0], to, cost + INSERT
            continue
        kept = _kept(state, code)
        if kept is not None and cut + after[kept] == open_:
            return edits + "K", kept, cost + cut
        return edits + "R" + ROLES[to][0], to, cost + REROLE + cut


def costs_before(codes: list[int], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The costs (up to a constant) before each row and, last, after all."""
    out = [after]
    for code in reversed(codes):
        out.append(step(out[-1], code)[0])
    return out[::-1]


def rerun(codes: list[int], after: tuple[int, ...], old: tuple[int, ...], result: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before all rows for new costs after them, given the result for the old ones.

    Stops where both differ only by a constant: from there on they stay so.
    """
    for code in reversed(codes):
        if after == old:
            return result
        after, old = step(after, code)[0], step(old, code)[0]
    return result if after == old else after


def trace(codes: list[int], after: tuple[int, ...], state: int, last: bool) -> tuple[list[str], int, int]:
    """The edits of each row (those after the last one included), the state then and the cost."""
    edits, total = [], 0
    for code, costs in zip(codes, costs_before(codes, after)[1:]):
        edit, state, cost = choice(costs, code, state)
        edits.append(edit)
        total += cost
    while last and END[state]:
        state = NEXT[state]
        edits[-1] += "I" + ROLES[state][0]
        total += INSERT
    return edits, state, total


def matrix(codes: list[int]) -> list[int]:
    """Least costs from each state before the rows to each state after them (16 numbers)."""
    columns = []
    for target in range(4):
        costs, total = tuple(0 if s == target else FAR for s in range(4)), 0
        for code in reversed(codes):
            costs, least = step(costs, code)
            total += least
        columns.append([min(FAR, c + total) if c < FAR else FAR for c in costs])
    return [columns[t][s] for s in range(4) for t in range(4)]


def product(a: list[int], b: list[int]) -> list[int]:
    """Both matrices one after the other, least costs added."""
    return [min(FAR, *(a[4 * s + k] + b[4 * k + t] for k in range(4))) for s in range(4) for t in range(4)]


def products(chunks: DataFrame, most: int, *, forward: bool) -> DataFrame:
    """conv_id, chunk, m: the product of the matrices ``m`` up to each chunk, or from each chunk on.

    The reach doubles in each round, so a conversation of n chunks takes log n joins on its chunk
    numbers; no task sees all chunks of a conversation.
    """
    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = zip(pdf["m"], pdf["other"])
            m = [list(a) if b is None else product(b, a) if forward else product(a, b) for a, b in pairs]
            yield pdf[["conv_id", "chunk"]].assign(m=m)

    reach, schema = 1, chunks.select("conv_id", "chunk", "m").schema
    while reach < most:
        by = reach if forward else -reach
        other = chunks.select(F.col("conv_id").alias("_c"), (F.col("chunk") + by).alias("_n"), F.col("m").alias("other"))
        joined = chunks.join(other, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_n")), "left")
        chunks = checkpointed(joined.select("conv_id", "chunk", "m", "other").mapInPandas(both, schema))
        reach *= 2
    return chunks


class Repair(NamedTuple):
    """The rows with their faults, the edits of every row, and each conversation's stretches."""

    rows: DataFrame  # conv_id, turn, role, text, pos, fault
    edits: DataFrame  # conv_id, pos, edits
    stretches: DataFrame  # conv_id, chunk, first, last, illegal, cost, audit


def with_faults(rows: DataFrame, order: Order) -> DataFrame:
    """conv_id, turn, role, text in order, with ``pos``, ``fault`` and the number of their stretch.

    The first fault of a row counts: blank (nothing but white space), duplicate (role and text stand
    earlier in the conversation), truncated (the last character that is no white space is not one of
    ``.!?``).  A first row is found by its place, so a text that fills a conversation is a hot key in
    no join.
    """
    same = [F.xxhash64(F.lit(k), "role", "text").alias(f"same{k}") for k in (1, 2)]
    bare = F.rtrim("text", F.lit(SPACE))
    laid = laid_out(rows.select("conv_id", "turn", "role", "text"), order)
    placed = checkpointed(ordinal(laid, order, "pos").select(
        "conv_id", "turn", "role", "text", "pos", F.col(order.range).alias("chunk"), *same,
        (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended")))
    firsts = placed.groupBy("conv_id", "same1", "same2").agg(F.min("pos").alias("_pos"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), "_pos")
    found = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    fault = (F.when(F.col("blank"), "blank").when(F.col("_pos").isNull(), "duplicate")
             .when(~F.col("ended"), "truncated"))
    return found.select("conv_id", "turn", "role", "text", "pos", "chunk", fault.alias("fault"))


def _solved(chunks: DataFrame, kind: str) -> DataFrame:
    """``chunks`` with ``after``: the costs (up to a constant) behind each chunk's rows."""
    schema = f"{_CHUNK.format(kind)}, after array<int>, before array<int>"

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            after = [END if last else GUESS for last in pdf["last"]]
            before = [costs_before(list(c), a)[0] for c, a in zip(pdf["codes"], after)]
            yield pdf.assign(after=[list(a) for a in after], before=[list(b) for b in before])

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for codes, old, result, new in zip(pdf["codes"], pdf["after"], pdf["before"], pdf["new"]):
                if new is None or list(new) == list(old):
                    rows.append((list(old), list(result)))
                else:
                    rows.append((list(new), list(rerun(list(codes), tuple(new), tuple(old), tuple(result)))))
            yield pdf[["conv_id", "chunk", "codes", "last"]].assign(after=[a for a, _ in rows], before=[b for _, b in rows])

    def follow(chunks: DataFrame) -> DataFrame:
        following = chunks.select(
            F.col("conv_id").alias("_conv"), (F.col("chunk") - 1).alias("_chunk"), F.col("before").alias("new"))
        return chunks.join(
            following, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), "left"
        ).drop("_conv", "_chunk")

    chunks = checkpointed(chunks.mapInPandas(guess, schema))
    for _ in range(PASSES):
        followed = follow(chunks)
        if followed.filter("new IS NOT NULL AND new != after").isEmpty():
            return chunks
        chunks = checkpointed(followed.mapInPandas(fix, schema))
    if follow(chunks).filter("new IS NOT NULL AND new != after").isEmpty():
        return chunks

    def to_matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["conv_id", "chunk"]].assign(m=[matrix(list(c)) for c in pdf["codes"]])

    def from_matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[min(m[4 * s + t] + END[t] for t in range(4)) for s in range(4)] for m in pdf["m"]]
            yield pdf[["conv_id", "chunk"]].assign(before=[[c - min(r) for c in r] for r in rows])

    most = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    all_ = products(chunks.mapInPandas(to_matrix, f"conv_id {kind}, chunk int, m array<int>"), most, forward=False)
    exact = all_.mapInPandas(from_matrix, f"conv_id {kind}, chunk int, before array<int>")
    exact = exact.select(F.col("conv_id").alias("_c"), (F.col("chunk") - 1).alias("_n"), F.col("before").alias("new"))
    return chunks.drop("before").join(
        exact, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_n")), "left"
    ).select("conv_id", "chunk", "codes", "last", F.coalesce("new", "after").alias("after"))


def repair(conversations: DataFrame, *, ranges: int | None = None) -> Repair:
    """The cheapest edits that make the roles of every conversation ``(s?(ua)+)?``.

    A row is kept (K, free), gets the role user or assistant (R, 2) or is deleted (D, 3, the only way
    for blank and duplicate rows); empty user or assistant rows are inserted anywhere (I, 2); a
    truncated row that stays costs 1 more.  Of the cheapest ways the one whose letters come first in
    ASCII is taken.  A role counts by its first letter.

    The rows are cut into ranges of (conv_id, turn, role, text), so a conversation that holds most
    rows is cut into as many stretches as it fills ranges.  A stretch is one cell of small codes.
    Stretches start from speculative costs behind them; passes rerun those whose successor says
    otherwise, until costs differ by constants only.  Where they never do (rows that must all go hand
    costs through unchanged), the few stretches are solved for all inputs and multiplied by doubling.

    Null roles and texts are one blank, null turns come first, and a null conv_id is a conversation;
    rows of one turn follow role and text; repeated rows are duplicates; other columns are not read;
    an empty table gives empty results.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    order = Order(("conv_id",), ("turn", "role", "text"), ranges)
    rows = checkpointed(with_faults(conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]), order))
    initial = F.substring("role", 1, 1)
    code = (
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
        + F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNotNull(), FORCED).otherwise(0)
    ).cast("tinyint")
    cells = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"))))
    stretches = checkpointed(rows.groupBy("conv_id", "chunk").agg(cells.alias("cells")).select(
        "conv_id", "chunk", F.get("cells", F.lit(0))["pos"].alias("first"),
        F.transform("cells", lambda c: c["code"]).alias("codes")))
    ends = stretches.groupBy("conv_id").agg(F.max("chunk").alias("_last"), F.count("*").alias("n"))
    ends = ends.withColumnRenamed("conv_id", "_conv")
    known = checkpointed(stretches.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "chunk", "first", "codes", (F.col("chunk") == F.col("_last")).alias("last"), "n"))

    several = known.filter("n > 1").select("conv_id", "chunk", "codes", "last")
    single = known.filter("n = 1").select(
        "conv_id", "chunk", "first", "codes", "last", F.array(*map(F.lit, END)).alias("after"), F.lit(NOTHING).alias("state"))
    if not several.isEmpty():
        solved = checkpointed(_solved(several, kind))

        def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                m = []
                for codes, after, last in zip(pdf["codes"], pdf["after"], pdf["last"]):
                    to = [trace(list(codes), tuple(after), s, last)[1] for s in range(4)]
                    m.append([0 if to[s] == t else FAR for s in range(4) for t in range(4)])
                yield pdf[["conv_id", "chunk"]].assign(m=m)

        most = known.agg(F.max("n")).first()[0]
        maps = products(solved.mapInPandas(ways, f"conv_id {kind}, chunk int, m array<int>"), most, forward=True)
        entered = maps.select(
            F.col("conv_id").alias("_c"), (F.col("chunk") + 1).alias("_n"),
            (F.array_position(F.slice("m", 4 * NOTHING + 1, 4), F.lit(0)) - 1).cast("int").alias("state"))
        firsts = known.select(F.col("conv_id").alias("_fc"), F.col("chunk").alias("_fn"), "first")
        many = solved.join(
            entered, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_n")), "left"
        ).join(firsts, F.col("conv_id").eqNullSafe(F.col("_fc")) & (F.col("chunk") == F.col("_fn")))
        single = single.unionByName(many.select(
            "conv_id", "chunk", "first", "codes", "last", "after", F.coalesce("state", F.lit(NOTHING)).alias("state")))

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [trace(list(c), tuple(a), s, x) for c, a, s, x in zip(pdf["codes"], pdf["after"], pdf["state"], pdf["last"])]
            yield pdf[["conv_id", "chunk", "first", "codes"]].assign(edits=[e for e, _, _ in done], cost=[c for _, _, c in done])

    traced = checkpointed(single.mapInPandas(
        edit, f"conv_id {kind}, chunk int, first long, codes array<tinyint>, edits array<string>, cost long"))
    kinds = F.transform("codes", lambda c: c.bitwiseAND(F.lit(3).cast("tinyint")).cast("int"))
    legal = [10 * SYSTEM + USER, 10 * USER + ASSISTANT, 10 * ASSISTANT + USER]
    size = F.size("kinds")
    illegal = F.size(F.filter(
        F.zip_with(F.slice("kinds", F.lit(1), size - 1), F.slice("kinds", F.lit(2), size), lambda a, b: 10 * a + b),
        lambda pair: ~pair.isin(*legal)))
    audit = F.regexp_replace(F.array_join("edits", ""), "[a-z]", "")
    parts = traced.withColumn("kinds", kinds).select(
        "conv_id", "chunk", "first", illegal.cast("long").alias("illegal"), "cost", audit.alias("audit"),
        F.get("kinds", F.lit(0)).alias("head"), F.element_at("kinds", -1).alias("tail"))
    # A pair of rows across a cut is counted with the later stretch.
    before = parts.select(F.col("conv_id").alias("_c"), (F.col("chunk") + 1).alias("_n"), F.col("tail").alias("_tail"))
    parts = parts.join(
        before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_n")), "left"
    ).withColumn("illegal", F.col("illegal") + F.when((10 * F.col("_tail") + F.col("head")).isin(*legal), 0)
                 .when(F.col("_tail").isNotNull(), 1).otherwise(0))
    edits = traced.select("conv_id", "first", F.posexplode("edits").alias("at", "edits")).select(
        "conv_id", (F.col("first") + F.col("at")).alias("pos"), "edits")
    return Repair(
        rows.select("conv_id", "turn", "role", "text", "pos", "fault"), edits,
        parts.select("conv_id", "chunk", "first", "illegal", "cost", "audit"))


def repaired(fixed: Repair) -> DataFrame:
    """conv_id, pos, step, edit, role, text: every edit in order, deleted rows (D) included.

    Inserted rows stand at the place of a neighbouring row, ``step`` orders them.
    """
    edits = fixed.edits.withColumnRenamed("conv_id", "_conv").withColumnRenamed("pos", "_pos")
    joined = fixed.rows.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")))
    each = joined.select(
        "conv_id", "pos", "role", "text", F.posexplode(F.regexp_extract_all("edits", F.lit("([A-Z][a-z]?)"))).alias("step", "what"))
    edit, to = F.substring("what", 1, 1), F.substring("what", 2, 1)
    role = F.when(to == "u", "user").when(to == "a", "assistant").otherwise(F.col("role"))
    return each.select(
        "conv_id", "pos", "step", edit.alias("edit"), role.alias("role"),
        F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


def text_digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines ``role:text`` of what ``repaired`` gave.

    A digest runs over a conversation from front to back, so its rows pass through one task, sorted,
    one batch at a time; the task keeps the state of one digest and no text.
    """
    kept = rows.filter("edit != 'D'").select(
        "conv_id", "pos", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield from table(done, batch.schema)
            kind = batch.schema
        if digest is not None:
            yield from table([(current, digest.hexdigest())], kind)

    def table(done: list[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in done], kind.field("conv_id").type), pa.array([d for _, d in done], pa.string())],
                ["conv_id", "repaired_sha256"])

    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").mapInArrow(each, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by rule, nulls of role and text as one blank.

    crc32 of ``conv_id:turn`` modulo 20 says what happens: 0 drops the row, 1 empties its text, 2
    removes its ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), what.alias("what"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("what != 0").select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def summary(conversations: DataFrame, fixed: Repair) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, faults, illegal pairs, cost, audit and digest of the repair."""
    turns = fixed.rows.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "audit"))), lambda p: p["audit"])
    whole = fixed.stretches.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts, "").alias("audit"))
    out = conversations.select("conv_id").distinct()
    for part in (counts, whole, text_digests(repaired(fixed))):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
