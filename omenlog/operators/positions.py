"""Positions of words on their way to the tasks that count them, and back to their lines.

A position as a row of its own takes some forty bytes in a shuffle, most of it its three words.
Here a row is a block of positions with one list of the words in them: Spark deals the blocks out,
NumPy cuts and counts them.  A block is a few arrays, each compressed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from omenlog.functions.words import END, START

#: Positions that a task cuts into blocks at once.
AT_ONCE = 4_000_000
MOVED = "part int, block binary"
COUNTED = "part int, block binary, key long, pos int, left string, word string, from_left int"
FOLLOWED = "part int, key long, pos int, left string, word string, c2 long, n2 long, m2 long"
SIGNALS = "key long, errors array<double>, probs array<double>"


@dataclass(frozen=True)
class Frequent:
    """Pairs of neighbours that would fill a task, with their counts, and the triples that would."""

    pairs: Sequence[tuple[str, str, int, int]] = ()  # left, right, n3, m3
    triples: Sequence[tuple[int, str, int]] = ()  # number of the pair, word, c3

    def find(self, names: pa.Array, left: np.ndarray, right: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where ``left`` and ``right`` (numbers of ``names``) are a frequent pair, and which; the same for triples."""
        own = [_codes([p[i] for p in self.pairs], names) for i in (0, 1)]
        known = (own[0] >= 0) & (own[1] >= 0)
        # most positions have a word that is in no frequent pair on this side
        some = [np.zeros(len(names), dtype=bool) for _ in own]
        for marks, codes in zip(some, own):
            marks[codes[known]] = True
        at = np.flatnonzero(some[0][left] & some[1][right])
        here, which = _found(_both(left[at], len(names), right[at]), np.where(known, own[0] * len(names) + own[1], -1))
        here = at[here]
        own = _codes([t[1] for t in self.triples], names)
        wanted = np.where(own >= 0, np.array([t[0] for t in self.triples], dtype=np.int64) * len(names) + own, -1)
        mine, hot = _found(which * len(names) + word[here], wanted)
        return here, which, here[mine], hot


def _codes(words: Sequence[str] | pa.Array, names: pa.Array) -> np.ndarray:
    """The numbers of words among ``names``, -1 for others."""
    coded = pa.array(words, names.type).dictionary_encode()
    at = pc.index_in(names, value_set=coded.dictionary)
    where = np.full(len(coded.dictionary), -1, dtype=np.int64)
    where[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return where[coded.indices.to_numpy()]


def _found(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``codes`` that hold a wanted number (not below 0), and which one."""
    if not len(wanted):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(wanted)
    at = np.minimum(np.searchsorted(wanted, codes, sorter=order), len(wanted) - 1)
    here = np.flatnonzero(wanted[order[at]] == codes)
    return here, order[at[here]]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def bucket(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


#: What a block is compressed with: a codec call for each array takes a fifth of the time of an Arrow stream.
ZSTD = pa.Codec("zstd", compression_level=1)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in UTF-8, one after the other, and how many each has."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # without an offset of its own
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]], np.diff(ends).astype(np.int64)


def _packed(**columns) -> bytes:
    """Named arrays of numbers or strings as one block."""
    named = {}
    for n, a in columns.items():
        if isinstance(a, pa.Array):
            data, sizes = flat_bytes(a)
            named[n], named[f"{n}/data"] = _small(sizes), data
        else:
            named[n] = np.ascontiguousarray(a)
    bodies = [ZSTD.compress(a, asbytes=True) if a.nbytes else b"" for a in named.values()]
    head = json.dumps([(n, a.dtype.str, len(a), len(b)) for (n, a), b in zip(named.items(), bodies)]).encode()
    return b"".join([len(head).to_bytes(4, "little"), head, *bodies])


def _unpacked(block: pa.Scalar) -> dict[str, np.ndarray | pa.Array]:
    data = memoryview(block.as_buffer())
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for n, kind, size, packed in json.loads(bytes(data[4:at])):
        whole = size * np.dtype(kind).itemsize
        raw = ZSTD.decompress(data[at:at + packed], whole) if whole else b""
        at += packed
        if n.endswith("/data"):
            n = n.removesuffix("/data")
            ends = np.concatenate([[0], np.cumsum(out[n])]).astype(np.int32)
            out[n] = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
        else:
            out[n] = np.frombuffer(raw, kind)
    return out


def _small(codes: np.ndarray) -> np.ndarray:
    """As unsigned numbers of as few bytes as they need."""
    most = int(codes.max(initial=0))
    return codes.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the stretches of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _steps(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Keys as the first one and the steps from there, for ``_keys``."""
    steps = np.diff(keys)
    return {"first": keys[:1].astype(np.int64), "key": steps if steps.min(initial=0) < 0 else _small(steps)}


def _keys(block: dict) -> np.ndarray:
    """The key of each position of a block."""
    return np.repeat(np.cumsum(np.concatenate([block["first"], block["key"].astype(np.int64)])), block["size"])


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Places by part, in their order inside each: numbers of two bytes are sorted by their digits."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


class _Own:
    """The words of one block among all that a task knows."""

    def __init__(self, names: pa.Array) -> None:
        self.names, self.here, self.number = names, np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=np.int64)

    def __call__(self, *codes: np.ndarray) -> tuple:
        """These words, and ``codes`` as small numbers of them."""
        for c in codes:
            self.here[c] = True
        own = np.flatnonzero(self.here)
        self.here[own], self.number[own] = False, np.arange(len(own))
        kind = _small(np.array([max(len(own) - 1, 0)])).dtype
        return self.names.take(pa.array(own)), *(self.number[c].astype(kind) for c in codes)


#: Bytes of blocks that leave a task at once.
SENT = 4 << 20


def _sent(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Blocks with their part as rows, many in a batch."""
    held, size = [], 0
    for part, block in blocks:
        held.append((part, block))
        size += len(block)
        if size >= SENT:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(blocks: Sequence[tuple[int, bytes]]) -> pa.RecordBatch:
    part, block = zip(*blocks)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(block, pa.binary())], names=["part", "block"])


def split(lines: pa.Array) -> pa.Array:
    """Whitespace-separated words, as ``functions.words.words`` cuts them."""
    lists = pc.ascii_split_whitespace(lines)
    some = pc.not_equal(lists.flatten(), "")
    if pc.all(some).as_py() is not False:
        return lists
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    lengths = np.bincount(np.repeat(np.arange(len(lists)), lengths)[some.to_numpy(zero_copy_only=False)], minlength=len(lists))
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), lists.flatten().filter(some))


def _at_once(blocks: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``blocks`` on the lines of a task, so many at a time that they hold ``AT_ONCE`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            yield from _sent(blocks(table))

    return run


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The lines of a task, so many at a time that they hold ``AT_ONCE`` words.  Texts (``words``) are cut, lists are not."""
    held, size = [], 0
    for batch in batches:
        if not pa.types.is_list(batch.column("words").type):
            batch = batch.set_column(batch.schema.get_field_index("words"), "words", split(batch.column("words")))
        held.append(batch)
        size += len(batch.column("words").flatten())
        if size >= AT_ONCE:
            yield _whole(held)
            size = 0
            pa.default_memory_pool().release_unused()
    if size:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> pa.Table:
    """The batches as one table; the list is emptied, so that they go."""
    table = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    return table


def _neighbours(lists: pa.Array) -> tuple:
    """The different words of lines, the numbers of each word and of its neighbours in them, its line, and the lines' starts."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    coded = pa.concat_arrays([pa.array([START, END], lists.type.value_type), lists.flatten()]).dictionary_encode()
    word = coded.indices.to_numpy()[2:]  # of four bytes, see ``_both``
    full = lengths > 0
    left, right = np.zeros_like(word), np.ones_like(word)
    left[1:], right[:-1] = word[:-1], word[1:]
    left[starts[full]], right[(starts + lengths - 1)[full]] = 0, 1
    return coded.dictionary, left, word, right, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), starts


def _both(a: np.ndarray, names: int, b: np.ndarray) -> np.ndarray:
    """Two numbers of names as one of eight bytes."""
    out = a.astype(np.int64)
    out *= names
    out += b
    return out


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, with the sum of their counts."""
    order = np.argsort(codes)
    codes = codes[order]
    starts = _runs(codes)
    return codes[starts], np.add.reduceat(counts[order].astype(np.int64, copy=False), starts) if len(starts) else np.zeros(0, np.int64)


def _hashes(names: pa.Array) -> np.ndarray:
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of lines (``copies, words``), ``AT_ONCE`` words at a time, with their copies."""
    for table in tables(batches):
        lists = table["words"].chunk(0)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        c = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(c, coded.indices.to_numpy(), np.repeat(table["copies"].to_numpy(), lengths))
        yield pa.record_batch([coded.dictionary.cast(pa.string()), pa.array(c)], names=["word", "c"])


def count_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pairs of neighbours in lines (``copies, words``), ``AT_ONCE`` words at a time, with their positions."""
    for table in tables(batches):
        names, left, _, right, _, _ = _neighbours(table["words"].chunk(0))
        pairs, n = summed(_both(left, len(names), right), np.ones(len(left), dtype=np.int64))
        sides = [names.take(pa.array(c)).cast(pa.string()) for c in (pairs // len(names), pairs % len(names))]
        yield pa.record_batch([*sides, pa.array(n)], names=["left", "right", "n"])


def count_triples(often: Frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The different words between the pairs of ``often`` in lines (``copies, words``): ``pair`` by number, copies and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            names, left, word, right, line, _ = _neighbours(table["words"].chunk(0))
            here, which, _, _ = often.find(names, left, right, word)
            codes, copies = which * len(names) + word[here], table["copies"].to_numpy()[line[here]]
            order = np.argsort(codes)
            codes, starts = codes[order], _runs(codes[order])
            own = codes[starts]
            yield pa.record_batch([
                pa.array((own // len(names)).astype(np.int32)), names.take(pa.array(own % len(names))).cast(pa.string()),
                pa.array(np.add.reduceat(copies[order].astype(np.int64), starts) if len(starts) else own),
                pa.array(np.diff(np.append(starts, len(codes)))),
            ], names=["pair", "word", "c3", "n"])

    return run


def _to_left(names: pa.Array, left: np.ndarray, word: np.ndarray, spread: Sequence[str], parts: int) -> np.ndarray:
    """The task of each left word, or of the pair where the left word is one of ``spread``."""
    h = _hashes(names)
    to = _mixed(h[left])
    wide = np.zeros(len(names), dtype=bool)
    at = _codes(spread, names)
    wide[at[at >= 0]] = True
    here = wide[left]
    to[here] = _mixed(to[here] + h[word[here]])
    return (to % np.uint64(parts)).astype(np.int32)


def cut(parts: int, often: Frequent, turn: int = 0, turns: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (``key, copies, words``) as blocks of positions for the task of their pair of neighbours.

    Frequent pairs go to the task of their triple, frequent triples anywhere.  Only every ``turns``-th
    task has its ``turn``; the others have theirs in other runs.
    """

    def blocks(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        names, left, word, right, line, starts = _neighbours(table["words"].chunk(0))
        keys = pc.fill_null(table["key"], -1).to_numpy()  # -1: of the training only
        copies = table["copies"].to_numpy()
        h = _hashes(names)
        to = _mixed(_mixed(h[left]) + h[right])
        here, _, hot, _ = often.find(names, left, right, word)
        to[here] = _mixed(to[here] + h[word[here]])
        to[hot] = _mixed(to[hot] + hot.astype(np.uint64))
        part = (to % np.uint64(parts)).astype(np.int32)
        del to, h
        order = np.flatnonzero(part % turns == turn)
        order = order[_by_part(part[order], parts)]
        part, left, word, right, line = (v[order] for v in (part, left, word, right, line))
        pos, own = order - starts[line], _Own(names)
        bounds = np.append(_runs(part), len(order))
        for a, b in zip(bounds, bounds[1:]):
            mine, *codes = own(left[a:b], word[a:b], right[a:b])
            runs = _runs(line[a:b])
            lines = line[a:b][runs]
            yield part[a], _packed(
                names=mine, left=codes[0], word=codes[1], right=codes[2], **_steps(keys[lines]),
                copies=_small(copies[lines]), size=_small(np.diff(np.append(runs, b - a))), pos=_small(pos[a:b]),
            )

    return _at_once(blocks)


def cut_pairs(parts: int, spread: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (``copies, words``) as blocks of counted pairs of words for the task of the left one.

    The pairs of the words in ``spread`` go to many tasks.
    """

    def blocks(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        names, left, word, _, line, _ = _neighbours(table["words"].chunk(0))
        pairs, c = summed(_both(left, len(names), word), table["copies"].to_numpy()[line])
        left, word = pairs // len(names), pairs % len(names)
        part = _to_left(names, left, word, spread, parts)
        order = _by_part(part, parts)
        part, left, word, c = (v[order] for v in (part, left, word, c))
        bounds, own = np.append(_runs(part), len(order)), _Own(names)
        for a, b in zip(bounds, bounds[1:]):
            mine, *codes = own(left[a:b], word[a:b])
            yield part[a], _packed(names=mine, left=codes[0], word=codes[1], c=_small(c[a:b]))

    return _at_once(blocks)


def count_pairs(asked: pa.Table, table: pa.Table) -> pa.Table:
    """``c2`` of the asked positions, and what the pairs of this task add to ``n2`` and ``m2`` of their left words."""
    blocks = [_unpacked(b) for b in table["block"]]
    none = pa.array([], pa.string())
    coded = pa.concat_arrays([none, *[b["names"] for b in blocks]]).dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    pairs, counts, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for b in blocks:
        own = codes[seen:seen + len(b["names"])]
        seen += len(own)
        pairs.append(own[b["left"]] * len(names) + own[b["word"]])
        counts.append(b["c"].astype(np.int64))
    pairs, c2 = summed(np.concatenate(pairs), np.concatenate(counts))
    left = pairs // max(len(names), 1)
    starts = _runs(left)
    ask = [_codes(asked[n].combine_chunks(), names) for n in ("left", "word")]
    place, which = _found(np.where((ask[0] >= 0) & (ask[1] >= 0), ask[0] * len(names) + ask[1], -2), pairs)
    found = np.zeros(len(asked), dtype=np.int64)
    found[place] = c2[which]
    lefts = names.take(pa.array(left[starts])) if len(starts) else none
    mine = {n: asked[n].combine_chunks() for n in ("part", "key", "pos", "left", "word")}
    add = {"left": lefts, "n2": np.add.reduceat(c2, starts) if len(starts) else starts, "m2": np.maximum.reduceat(c2, starts) if len(starts) else starts}
    kinds = {"part": pa.int32(), "key": pa.int64(), "pos": pa.int32(), "left": pa.string(), "word": pa.string(), "c2": pa.int64(), "n2": pa.int64(), "m2": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def filled(have: dict, n: int) -> pa.Table:
        return pa.table([pa.array(have[c], t) if c in have and not isinstance(have[c], (pa.Array, pa.ChunkedArray)) else
                         have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in kinds.items()], schema=schema)

    return pa.concat_tables([filled(mine | {"c2": found}, len(asked)), filled(add, len(starts))])


def count(parts: int, often: Frequent, spread: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """Counts of the positions of one task: blocks for the task of their line.

    Positions of pairs that were never seen come as rows with their words instead.
    """

    def run(table: pa.Table) -> pa.Table:
        blocks = [_unpacked(b) for b in table["block"]]
        table = None
        coded = pa.concat_arrays([b["names"] for b in blocks]).dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        parts_of = {n: [] for n in ("left", "word", "right", "key", "copies", "pos")}
        seen = 0
        for b in blocks:
            own = codes[seen:seen + len(b["names"])]
            seen += len(own)
            for n in ("left", "word", "right"):
                parts_of[n].append(own[b[n]])
            parts_of["key"].append(_keys(b))
            parts_of["copies"].append(np.repeat(b["copies"].astype(np.int64), b["size"]))
            parts_of["pos"].append(b["pos"].astype(np.int64))
        blocks = None
        left, word, right, key, copies, pos = (np.concatenate(v) for v in parts_of.values())
        parts_of = None
        pair = left * len(names) + right
        if len(names) < 1 << 20:  # one number for the triple
            order = np.argsort(pair * len(names) + word)
        else:
            order = np.lexsort((word, pair))
        p, w = pair[order], word[order]
        at3 = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])]))
        c3 = np.add.reduceat(copies[order], at3)
        p3 = p[at3]
        here, which, hot, triple = often.find(names, p3 // len(names), p3 % len(names), w[at3])
        c3[hot] = np.array([t[2] for t in often.triples], dtype=np.int64)[triple]
        at2 = _runs(p3)
        in_pair = np.diff(np.append(at2, len(p3)))
        n3, m3 = np.repeat(np.add.reduceat(c3, at2), in_pair), np.repeat(np.maximum.reduceat(c3, at2), in_pair)
        for total, i in ((n3, 2), (m3, 3)):
            total[here] = np.array([q[i] for q in often.pairs], dtype=np.int64)[which]
        triple = np.empty(len(order), dtype=np.int64)
        triple[order] = np.repeat(np.arange(len(at3)), np.diff(np.append(at3, len(order))))
        asked = key >= 0
        new = np.flatnonzero(asked & (n3[triple] == 0))
        old = np.flatnonzero(asked & (n3[triple] > 0))
        # blocks of the positions that are answered; the words of a line came together and in order
        to = bucket(key[old], parts)
        by = _by_part(to, parts)
        old, to = old[by], to[by]
        key3, pos3, triple = key[old], pos[old], triple[old]
        c3, n3, m3 = c3[triple], n3[triple], m3[triple]
        bounds = np.append(_runs(to), len(to))
        ids, packed = [], []
        for a, b in zip(bounds, bounds[1:]):
            lines = _runs(key3[a:b])
            packed.append(_packed(
                **_steps(key3[a:b][lines]), size=_small(np.diff(np.append(lines, b - a))), pos=_small(pos3[a:b]),
                c3=_small(c3[a:b]), n3=_small(n3[a:b]), m3=_small(m3[a:b]),
            ))
            ids.append(to[a])
        words = [names.take(pa.array(c[new])) for c in (left, word)]
        none, rest = pa.nulls(len(ids), pa.int64()), bucket(key[new], parts)
        return pa.table({
            "part": pa.concat_arrays([pa.array(np.array(ids, dtype=np.int32)), pa.array(rest)]),
            "block": pa.concat_arrays([pa.array(packed, pa.binary()), pa.nulls(len(new), pa.binary())]),
            "key": pa.concat_arrays([none, pa.array(key[new])]),
            "pos": pa.concat_arrays([none.cast(pa.int32()), pa.array(pos[new].astype(np.int32))]),
            "left": pa.concat_arrays([pa.nulls(len(ids), pa.string()), words[0].cast(pa.string())]),
            "word": pa.concat_arrays([pa.nulls(len(ids), pa.string()), words[1].cast(pa.string())]),
            "from_left": pa.concat_arrays([none.cast(pa.int32()), pa.array(_to_left(names, left[new], word[new], spread, parts))]),
        })

    return run


def gather(smoothing: float, room: float) -> Callable[[pa.Table], pa.Table]:
    """``key, errors, probs`` in word order, from the blocks and rows (``key, pos, err, prob``) of some lines."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_null(table["block"]))
        columns = {n: [rows[n].to_numpy()] for n in ("key", "pos", "err", "prob")}
        blocks = [_unpacked(block) for block in table["block"].drop_null()]
        if blocks:
            c3, n3, m3 = (np.concatenate([b[n] for b in blocks]).astype(np.float64) for n in ("c3", "n3", "m3"))
            total = n3 + room
            columns["key"].extend(_keys(b) for b in blocks)
            columns["pos"].extend(b["pos"].astype(np.int64) for b in blocks)
            columns["err"].append(-np.log((c3 + smoothing) / total))
            columns["prob"].append(1 - (m3 + smoothing) / total)
        key, pos, err, prob = (np.concatenate(v) for v in columns.values())
        line = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
        order = np.argsort(line * (int(pos.max(initial=0)) + 1) + pos)  # one number for line and place
        key = key[order]
        starts = _runs(key)
        ends = pa.array(np.append(starts, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (err, prob)]
        return pa.table({"key": key[starts], "errors": lists[0], "probs": lists[1]})

    return run


#: Bytes of lines that a task deals out at once.
TEXTS = 32 << 20


def deal(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (``key`` and more) as compressed blocks for the task of their key."""

    def blocks(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        part = bucket(pc.fill_null(table["key"], -1).to_numpy(), parts)
        order = _by_part(part, parts)
        table, part = table.take(pa.array(order)).combine_chunks(), part[order]
        bounds = np.append(_runs(part), len(part))
        for a, b in zip(bounds, bounds[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(a, b - a))
            yield part[a], sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TEXTS:
                yield from _sent(blocks(pa.Table.from_batches(held)))
                held, size = [], 0
        if held:
            yield from _sent(blocks(pa.Table.from_batches(held)))

    return run


def gather_texts(smoothing: float, room: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``errors, probs`` of ``gather`` beside the lines of ``deal`` that have some."""

    def run(table: pa.Table, dealt: pa.Table) -> pa.Table:
        signals = gather(smoothing, room)(table)
        lines = [pa.ipc.open_stream(block.as_buffer()).read_all() for block in dealt["block"]]
        lines = pa.concat_tables(lines).cast(schema) if lines else schema.empty_table()
        at = pc.index_in(lines["key"].combine_chunks(), value_set=signals["key"].combine_chunks())
        here = pc.is_valid(at)
        found = signals.select(["errors", "probs"]).take(at.filter(here))
        lines = lines.filter(here)
        for n in found.column_names:
            lines = lines.append_column(n, found[n])
        return lines

    return run
