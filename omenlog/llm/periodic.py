"""Periodic runs of words: maximal pairs of a bottom-up LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose suffixes are sorted together; a longer document is sorted by itself.
PORTION = 1 << 20

RUN = "start long, length long, period long"


class Numbers(dict):
    """Words as numbers in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated_suffixes(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next four words recur in their document, in suffix order, and the groups of equal four.

    ``words`` holds the documents one after another, each followed by a number of its own that
    stands nowhere else.  Prefix doubling: places are sorted by their first word, then by (rank
    here, rank h words on), where only ranks shared by several places are sorted again.
    """
    n = len(words)
    slots = np.arange(n)
    key = docs * (words.max() + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots ``at`` hold sorted ``key``: ranks of their places are renewed; which slots share a rank, and which."""
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        start = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        rank[order[at]] = start
        alone = head & np.append(head[1:], True)
        return at[~alone], start[~alone]

    def doubled(open_: np.ndarray, group: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups of places with the same h words become groups with the same 2 h words."""
        places = order[open_]
        key = group * (n + 1) + rank[places + h]
        by = np.argsort(key, kind="stable")
        order[open_] = places[by]
        return regroup(open_, key[by])

    open_, group = regroup(slots, key[order])
    for h in (1, 2):
        open_, group = doubled(open_, group, h)
    fours = open_, group
    while len(open_):
        h *= 2
        open_, group = doubled(open_, group, h)
    return order[fours[0]], fours[1]


def common_lengths(words: list[int], places: list[int], groups: list[int]) -> list[int]:
    """Common words of each place with the one before it in suffix order (0 where a group of four begins).

    Taken in text order: the place after one that shares l words with its predecessor shares l - 1 at least.
    """
    slot = {p: s for s, p in enumerate(places)}
    out = [0] * len(places)
    last, h = -2, 0
    for i in sorted(places):
        s = slot[i]
        h = h - 1 if i == last + 1 and h > 4 else 4
        last = i
        if s == 0 or groups[s] != groups[s - 1]:
            h = 0
            continue
        j = places[s - 1]
        while words[i + h] == words[j + h]:
            h += 1
        out[s] = h
    return out


class Interval:
    """The places below a node of the tree, all in order and as one list per word on their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}


def joined(a: Interval, b: Interval, length: int, power: int, words: list[int], found: dict[tuple[int, int], int]) -> Interval:
    """The node of both; ``found`` gets the runs that pairs of one place from each give.

    The pairs share exactly ``length`` words, so pairs with different words on their left are
    maximal, and one at distance q <= length / (power - 1) spans a run of length + q words.  Within
    that distance of a place i, the places on its right are whole periods away, so they all stand
    in the class of one left word; of those on its left only the first can be of another class.
    """
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = length // (power - 1)
    places, classes = a.places, a.classes
    for left, members in b.classes.items():
        for i in members:
            at = bisect_right(places, i)
            if at < len(places) and places[at] <= i + reach:
                other = words[places[at] - 1]
                if other != left:
                    same = classes[other]
                    for k in range(bisect_right(same, i), bisect_right(same, i + reach)):
                        _note(found, i, length, same[k] - i)
            if at and places[at - 1] >= i - reach:
                j = places[bisect_left(places, i - reach)]
                if words[j - 1] != left:
                    _note(found, j, length, i - j)
    if len(b.places) * 8 > len(places):
        a.places = sorted(places + b.places)
        for left, members in b.classes.items():
            classes[left] = sorted(classes.get(left, []) + members)
    else:
        for left, members in b.classes.items():
            mine = classes.setdefault(left, [])
            for i in members:
                insort(places, i)
                insort(mine, i)
    return a


def _note(found: dict[tuple[int, int], int], start: int, length: int, period: int) -> None:
    """Multiples of a period give the same stretch: the smallest one stays."""
    key = (start, length + period)
    found[key] = min(period, found.get(key, period))


def stretches(words: np.ndarray, docs: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the concatenated documents, by start, then period."""
    floor = min(max(least - q, (power - 1) * q) for q in range(1, least + 1))  # a run's pair shares so many words
    if floor < 4:
        raise ValueError("runs so short are not found by groups of four words")
    order, group = repeated_suffixes(words, docs)
    if not len(order):
        return []
    text, places = words.tolist(), order.tolist()
    shared = common_lengths(text, places, group.tolist())
    shared.append(0)
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Interval]] = []
    for s, place in enumerate(places):
        node, following = Interval(place, text[place - 1]), shared[s + 1]
        while stack and stack[-1][0] >= following:
            length, before = stack.pop()
            node = joined(before, node, length, power, text, found)
            if length == following:
                break
        if following >= floor:
            stack.append((following, node))
        else:
            stack.clear()
    return sorted((start, n, q) for (start, n), q in found.items() if n >= max(least, power * q))


def periodic_runs(docs: DataFrame, *, least: int = 6, power: int = 4, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``runs`` (array of start, length, period) and ``collapsed``.

    Words are the stretches without ASCII white space, numbered from 0.  A run is a stretch of at
    least ``least`` words and ``power`` (3 or more) times its smallest period that neither neighbour
    extends; runs come by start, then period.  ``collapsed`` holds the words, one space between
    them, without those that a run repeats: words of a run after its first period.

    Every document is worked on by itself where it stands, so nothing is shuffled, and a worker
    holds a portion of ``PORTION`` bytes or one document.  Null text is the empty text, which has
    no runs and collapses to nothing; null, repeated and tied rows are ordinary rows; columns
    called runs or collapsed are replaced; an empty table gives an empty result.
    """
    if power < 3:
        raise ValueError("power must be 3 or more")
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = T._parse_datatype_string(RUN)
    schema = T.StructType([
        inner.schema["doc"], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def portion(texts: list[str]) -> tuple[pa.Array, list[str]]:
        number = Numbers()
        split = [t.encode().split() for t in texts]
        sizes = np.array([len(w) + 1 for w in split])
        first = np.cumsum(sizes) - sizes + 1  # after a separator in front of all
        words = np.empty(1 + sizes.sum(), np.int64)
        for at, own in zip(first, split):
            words[at : at + len(own)] = list(map(number.__getitem__, own))
        ends = np.concatenate([[0], first + sizes - 1])
        words[ends] = len(number) + np.arange(len(ends))
        of = np.concatenate([[0], np.repeat(np.arange(len(split)), sizes)])
        found = np.array(stretches(words, of, least, power), np.int64).reshape(-1, 3)
        owner = of[found[:, 0]]
        found[:, 0] -= first[owner]
        bounds = np.searchsorted(owner, np.arange(len(split) + 1))
        out = []
        for k, own in enumerate(split):
            if bounds[k] < bounds[k + 1]:
                keep = np.ones(len(own), bool)
                for start, length, period in found[bounds[k] : bounds[k + 1]].tolist():
                    keep[start + period : start + length] = False
                own = [w for w, stays in zip(own, keep) if stays]
            out.append(b" ".join(own).decode())
        structs = pa.StructArray.from_arrays([pa.array(c) for c in found.T], ["start", "length", "period"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs), out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(sizes // PORTION, append=-1)) + 1
            for i, j in zip([0, *ends], ends):
                part = batch.slice(i, j - i)
                runs, collapsed = portion(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), runs, pa.array(collapsed, pa.string())], ["doc", "runs", "collapsed"])

    return inner.mapInArrow(each, schema).select("doc.*", "runs", "collapsed")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where one document in ten gets a periodic tail by rule.

    With h the crc32 of the id and g = floor(h / 10): if h is a multiple of ten and the text has
    n > 0 words, each word from a = g % n on becomes the word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)).  A null id leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def tail(at: Column) -> Column:
        a, p = at["a"], at["p"]
        return F.array_join(
            F.transform(F.sequence(F.lit(0), F.size(at["words"]) - 1), lambda i: F.get(
                at["words"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"), g.alias("g"))
    a = F.when(F.size("words") > 0, F.col("g") % F.size("words"))
    p = 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8))
    placed = chosen.withColumn("a", a).withColumn("p", p)
    return placed.select("doc_id", F.when(F.size("words") > 0, tail(F.struct("words", "a", "p"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run and digests of all runs and of the collapsed text."""
    order = F.array_sort(
        "runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1)).otherwise(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", F.get(order, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
