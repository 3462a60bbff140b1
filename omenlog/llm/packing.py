"""Best-fit packing of token sequences with large-item matching, planned on the counts of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omenlog.llm.bpe import PORTION, encoder
from omenlog.llm.common import numbered

#: A step of the plan: items ``first`` to ``first + count - 1`` of a length go to the sequences from
#: ``base`` on, ``each`` to a sequence, from ``offset`` on.
STEP = ("length", "first", "count", "base", "each", "offset")


class Plan:
    """Which items go where; items of one length are alike, so a step places many of them at once."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.taken = dict.fromkeys(counts, 0)
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: list[int] = []  # kinds of gaps, rising
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, number of sequences)]

    def put(self, length: int, count: int, base: int, each: int, gap: int) -> None:
        """``count`` items of a length into sequences with ``gap`` tokens free."""
        self.steps.append((length, self.taken[length], count, base, each, self.capacity - gap))
        self.taken[length] += count
        self.left[length] -= count

    def free(self, gap: int, base: int, number: int) -> None:
        if gap and number:
            if gap not in self.open:
                self.open[gap] = []
                insort(self.gaps, gap)
            self.open[gap].append((base, number))

    def start(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def match(self, large: list[int]) -> None:
        """Pairs of large items: the largest one left takes the largest that fits beside it.

        No three large items fit into a sequence.  What fits beside an item also fits beside a
        smaller one, so this greedy choice gives the most pairs there can be.
        """
        by = sorted(large)
        while by:
            a = by[-1]
            n = self.left[a]
            if 2 * a <= self.capacity and n > 1:
                pairs = n // 2
                base = self.start(pairs)
                self.put(a, 2 * pairs, base, 2, self.capacity)
                self.free(self.capacity - 2 * a, base, pairs)
            else:
                at = bisect_left(by, self.capacity - a + 1, 0, len(by) - 1) - 1  # the largest other one that fits
                b = by[at] if at >= 0 else None
                pairs = min(n, self.left[b]) if b else n
                base = self.start(pairs)
                self.put(a, pairs, base, 1, self.capacity)
                if b:
                    self.put(b, pairs, base, 1, self.capacity - a)
                    if not self.left[b]:
                        del by[at]
                self.free(self.capacity - a - (b or 0), base, pairs)
            if not self.left[a]:
                by.pop()

    def best_fit(self, small: list[int]) -> None:
        """Small items by falling length, each into the smallest gap that holds it, else into a new sequence.

        A gap that has taken an item is smaller than before, so while it holds another one of the
        same length it stays the best: each sequence of a gap takes as many as it holds.
        """
        for s in sorted(small, reverse=True):
            while self.left[s]:
                at = bisect_left(self.gaps, s)
                if at < len(self.gaps):
                    gap = self.gaps[at]
                    base, number = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap], self.gaps[at]
                else:
                    gap, number = self.capacity, -(-self.left[s] // (self.capacity // s))
                    base = self.start(number)
                each = gap // s
                full = min(number, self.left[s] // each)
                if full:
                    self.put(s, full * each, base, each, gap)
                    self.free(gap - each * s, base, full)
                rest = self.left[s] if full < number else 0
                if rest:
                    self.put(s, rest, base + full, rest, gap)
                    self.free(gap - rest * s, base + full, 1)
                    full += 1
                self.free(gap, base + full, number - full)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Where all items go, given how many there are of each length from 1 to ``capacity``."""
    done = Plan(counts, capacity)
    done.match([n for n in counts if 3 * n > capacity])
    done.best_fit([n for n in counts if 3 * n <= capacity])
    return done


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A bound from below: all tokens need so many, and so do the large items, two at most in each."""
    large = {n: c for n, c in counts.items() if 3 * n > capacity}
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), plan(large, capacity).sequences)


def placed(items: DataFrame, capacity: int, *, length_col: str = "length") -> DataFrame:
    """``items`` plus ``sequence_id`` and ``offset``: rows packed into sequences of ``capacity`` tokens.

    Items above a third of the capacity are matched in pairs, the others best-fit the gaps.  The
    driver sees how many items there are of each length (``capacity`` numbers at most) and plans in
    steps for many like items; an item finds its step by its number among the items of its length.
    Sequences are numbered from 0 and filled from 0 without gaps.  Items of equal length change
    places freely, so ties and repeated rows need no rule.  Lengths must lie between 1 and the
    capacity; another one, or a null, is an error.  Columns called sequence_id or offset are
    replaced.  An empty table gives an empty result.
    """
    spark = items.sparkSession
    kept = [F.col(f"`{c}`") for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    inner = items.select(F.struct(*kept).alias("item"), F.col(length_col).cast("long").alias("n"))
    rows = numbered(inner, "n", "rank")
    sizes = rows.groupBy("n").agg(F.count("*").alias("c"))
    found = sizes.agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n").isNull()).alias("nulls")).first()
    if found["nulls"] or (found["least"] is not None and not 1 <= found["least"] <= found["most"] <= capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    counts = {r["n"]: r["c"] for r in sizes.collect()}  # at most `capacity` rows
    steps = np.array(sorted(plan(counts, capacity).steps), np.int64).reshape(-1, len(STEP))
    held = spark.sparkContext.broadcast(steps)
    schema = T.StructType([
        inner.schema["item"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        # Steps are sorted by (length, first); both are searched at once as a rank among all items.
        lengths, at = np.unique(table[:, 0], return_index=True)
        totals = np.add.reduceat(table[:, 2], at) if len(table) else np.zeros(0, np.int64)
        before = np.cumsum(totals) - totals
        starts = table[:, 1] + np.repeat(before, np.diff([*at, len(table)]))
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "rank"))
            step = table[np.searchsorted(starts, before[np.searchsorted(lengths, n)] + rank, side="right") - 1]
            k = rank - step[:, 1]
            sequence, offset = step[:, 3] + k // step[:, 4], step[:, 5] + k % step[:, 4] * n
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(sequence), pa.array(offset)], ["item", "sequence_id", "offset"])

    return rows.mapInArrow(place, schema).select("item.*", "sequence_id", "offset")


def pieces(
    docs: DataFrame, path: str, *, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit): documents as tokens, cut where too long.

    A document is its ids by the tokenizer in ``path`` without special tokens added, then ``end``.
    One of more than ``capacity`` is cut into pieces of that many; the last one may be shorter.
    Null text is the empty text, one piece of the end token alone; null and repeated ids are
    ordinary rows; other columns are not read; an empty table gives an empty result.
    """
    inner = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([
        inner.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    last = int(end).to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(sizes // PORTION, append=-1)) + 1
            for i, j in zip([0, *ends], ends):
                part = batch.slice(i, j - i)
                whole = [ids + last for ids in tool.plain([t.encode() for t in part.column("text").to_pylist()])]
                cut = [(k, at) for k, ids in enumerate(whole) for at in range(0, len(ids), 4 * capacity)]
                owner, start = np.array(cut, np.int64).reshape(-1, 2).T
                ids = [whole[k][at : at + 4 * capacity] for k, at in cut]
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(owner)), pa.array((start // 4 // capacity).astype(np.int32)),
                    pa.array(start // 4), pa.array(length), pa.array(ids, pa.binary())], [f.name for f in schema])

    return inner.mapInArrow(each, schema)


def pack(docs: DataFrame, path: str, *, capacity: int = 4096, **kw) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of ``docs`` goes.

    As ``pieces`` and ``placed``; only the checksum of a piece's ids is kept, so what is written
    and numbered is a few numbers a piece.
    """
    cut = pieces(docs, path, capacity=capacity, **kw).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of whole sequences from ``placed`` pieces that carry their ``ids``.

    A group is one sequence, so it holds at most the capacity's tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length",
        F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"))
