"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omenlog.session import checkpointed

#: Bytes of a chunk: at least, about (cuts are that rare on average), at most.
LEAST, ABOUT, MOST = 64, 256, 1024
#: The dictionary of shared chunks has at most so many entries, so at most 8 MB of text.
DICTIONARY = 1 << 13
#: Bounds of what a worker remembers: words (two generations of so many), and chunks that are not in the dictionary.
WORDS, CHUNKS = 1 << 18, 1 << 14
#: Bytes of text that are encoded at a time.
PORTION = 1 << 20
#: Bytes whose rolling hashes are computed at a time.
STRIP = 1 << 20

_SPACE = b" \t\n\r"
_WORD = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_FIRST = re.compile(rb"[^ \t\n\r](?=[ \t\n\r])")
_MIX = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
_BASE = 0x2C1B3C6D


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of ``text``: where the rolling hash of the last 16 bytes says so.

    The hash sees content only, so equal passages are cut alike wherever they stand.
    """
    out, last = [], 0
    for at in range(0, len(text), STRIP):
        begin = max(0, at - 15)
        h = _MIX[np.frombuffer(text, np.uint8, min(len(text), at + STRIP) - begin, begin)]
        for width in (1, 2, 4, 8):
            power = np.uint32(pow(_BASE, width, 1 << 32))
            h[width:] += h[:-width] * power
        for end in (np.flatnonzero(h < np.uint32((1 << 32) // ABOUT)) + begin + 1).tolist():
            if end <= at:
                continue
            while end - last > MOST:
                last += MOST
                out.append(last)
            if end - last >= LEAST:
                last = end
                out.append(last)
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(text):
        out.append(len(text))
    return out


def chunks(text: bytes) -> list[bytes]:
    ends = cuts(text)
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def core(chunk: bytes) -> tuple[int, int]:
    """The part of a chunk between its first and last start of a run of white space (or nothing).

    A run of white space starts a new piece of text for the tokenizer whatever stands before it,
    so what lies between two such starts has the same tokens in every text.
    """
    found = _FIRST.search(chunk)
    if found is None:
        return len(chunk), len(chunk)
    last = max(map(chunk.rfind, (b" ", b"\t", b"\n", b"\r")))
    return found.end(), len(chunk[: last + 1].rstrip(_SPACE))


#: How a lower-casing tokenizer of words announces itself in its file.
_LOWER_CASED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Texts of these characters and white space are in normal form, and Python lower-cases and splits them as the library does.
_EASY_TEXT = re.compile("[!-~À-ÖØ-öø-ÿ \\t-\\r]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \\t-\\r]+")
#: The printable character for every byte of a piece; those that are none get the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = dict(zip((b for b in range(256) if b not in _PRINTABLE), range(256, 512)))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memory:
    """A dictionary of two generations: what was not asked for during a whole one is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: Collection) -> list:
        """Those of the (different) ``keys`` that are not known; all others can be read from ``new`` afterwards."""
        absent = [k for k in keys if k not in self.new]
        if len(self.new) + len(absent) > self.size:
            self.old, self.new = self.new, {}
            absent = list(keys)
        known = {k: self.old[k] for k in absent if k in self.old}
        self.new.update(known)
        return [k for k in absent if k not in known]


class Encoder:
    """Encodes and decodes in a worker; a word and a chunk are encoded once while remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shared: dict[bytes, bytes] = {}
        self.words = Memory(WORDS)
        told = json.loads(self.tokenizer.to_str())
        self.lower_cased = all(told[k] == v for k, v in _LOWER_CASED.items()) and told["model"]["type"] == "BPE"
        self.added = tuple(t["content"] for t in told["added_tokens"])
        # Without a decoder the library puts a blank between the tokens.
        self.tokens = None if self.tokenizer.decoder else [
            self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.cores: dict[bytes, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves: pieces, or words behind a blank.

        A lower-casing tokenizer's pieces are found in whole texts of easy characters, else in easy
        words; other words are left to the library.
        """
        if not self.lower_cased:
            return [" " + w.decode() for w in _WORD.findall(text.encode())]
        if _EASY_TEXT.fullmatch(text) and not self.special(text):
            return _PIECE.findall(text.lower())
        out: list[str] = []
        for w in (w.decode() for w in text.encode().split()):
            if _EASY_TEXT.fullmatch(w) and not self.special(w):
                out += _PIECE.findall(w.lower())
            else:
                out.append(" " + w)
        return out

    def special(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def new_ids(self, parts: list[str]) -> list[bytes]:
        """The ids of parts; a piece goes straight to the library's BPE, past its normalizer and its splitting."""
        words = [p[1:] for p in parts if p[0] == " "]
        found = iter(self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
        bpe = self.tokenizer.model.tokenize
        return [
            _packed(next(found).ids) if p[0] == " "
            else _packed([t.id for t in bpe(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))])
            for p in parts
        ]

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids (little-endian 32 bits) of texts that start with white space or stand alone.

        The parts of all texts are numbered, each different one is looked up or encoded once, and
        the ids of the texts are gathered from those of the parts.
        """
        split = [self.parts(t.decode()) for t in texts]
        numbered = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        parts = numbered.dictionary.to_pylist()
        new = self.words.missing(parts)
        self.words.new.update(zip(new, self.new_ids(new)))
        found = [self.words.new[w] for w in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        part = numbered.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes[part])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[part] - (ends - sizes[part]), sizes[part])
        out = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])].tolist()
        return [out[4 * i : 4 * j] for i, j in zip(bounds, bounds[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts: cores of chunks looked up, the joins between them encoded anew.

        The join of two chunks runs from the last start of white space of the left one to the
        first of the right one; over a chunk without any it grows on to the next.  There the
        encoding agrees with that of the whole text, so the result is exact.
        """
        plan, todo = [], {}
        for text in texts:
            parts, join = [], []
            for chunk in chunks(text):
                i, j = core(chunk)
                join.append(chunk[:i])
                if i < len(chunk):
                    parts.append(("join", b"".join(join)))
                    if i < j:
                        parts.append(("core", chunk[i:j]))
                    join = [chunk[j:]]
            parts.append(("join", b"".join(join)))
            plan.append(parts)
            for kind, part in parts:
                if not (kind == "core" and (part in self.shared or part in self.cores)):
                    todo[part] = kind
        new = dict(zip(todo, self.plain(list(todo))))
        out = [
            b"".join(new[p] if p in new else self.shared[p] if p in self.shared else self.cores[p] for _, p in parts)
            for parts in plan
        ]
        if len(self.cores) > CHUNKS:
            self.cores.clear()
        self.cores.update((p, new[p]) for p, kind in todo.items() if kind == "core")
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        lists = [np.frombuffer(x, dtype="<u4").tolist() for x in ids]
        if self.tokens is None:
            return self.tokenizer.decode_batch(lists, skip_special_tokens=False)
        return [" ".join(map(self.tokens.__getitem__, x)) for x in lists]


#: The encoders of this worker by path, kept from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, shared: dict[bytes, bytes] | None = None) -> Encoder:
    """This worker's encoder for the tokenizer in ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].shared = shared or {}
    return _ENCODERS[path]


def _key(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def dictionary(texts: DataFrame, path: str, entries: int = DICTIONARY) -> dict[bytes, bytes]:
    """Ids of the cores of the chunks that recur most across documents, each encoded once.

    Every chunk of every text is counted by a hash (per task first).  Of those in two or more
    documents, the ``entries`` that save most bytes are fetched from one document each, encoded by
    Spark and returned; their size is bounded by ``entries * MOST``.  The bound limits what is
    reused across executors, not what is encoded: other chunks are encoded where they stand.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list[int]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["key", "n", "size", "doc"]).astype("int64")

        for batch in batches:
            for text, doc in zip(batch["text"], batch["doc"]):
                for chunk in set(chunks((text or "").encode())):
                    entry = seen.setdefault(_key(chunk), [0, len(chunk), doc])
                    entry[0] += 1
            if len(seen) > 1 << 17:
                yield rows()
                seen.clear()
        yield rows()

    docs = texts.select("text", F.xxhash64("text").alias("doc"))
    counted = docs.mapInPandas(count, "key long, n long, size long, doc long").groupBy("key").agg(
        F.sum("n").alias("n"), F.max("size").alias("size"), F.min("doc").alias("doc"))
    saved = (F.col("n") - 1) * F.col("size")
    best = checkpointed(counted.filter("n > 1").orderBy(saved.desc(), "key").limit(entries).select("key", "doc"))
    keys = frozenset(r["key"] for r in best.select("key").collect())

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {_key(c): c for t in set(batch["text"]) for c in chunks((t or "").encode()) if _key(c) in keys}
            yield pd.DataFrame({"key": list(found), "chunk": list(found.values())}).astype({"key": "int64"})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path)
        for batch in batches:
            parts = sorted({c[i:j] for c in batch["chunk"] for i, j in [core(c)] if i < j})
            yield pd.DataFrame({"core": parts, "ids": tool.plain(parts)})

    where = best.select("doc").distinct()  # at most `entries` rows
    fetched = docs.join(F.broadcast(where), "doc", "left_semi").select("text").mapInPandas(fetch, "key long, chunk binary")
    once = fetched.groupBy("key").agg(F.min("chunk").alias("chunk"))
    rows = once.select("chunk").mapInPandas(encode, "core binary, ids binary").collect()
    return {bytes(r["core"]): bytes(r["ids"]) for r in rows}


def encode(docs: DataFrame, path: str, *, text_col: str = "text", entries: int = DICTIONARY) -> DataFrame:
    """All columns of ``docs`` but the text, plus ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    ``path`` names the file of a tokenizer that starts a new piece at white space; ids are exactly
    those of the library on the whole text without special tokens added, ``decoded`` its decoding
    of them.  Null text is the empty text (no ids, empty decoding); null and repeated ids of
    documents are ordinary rows; columns called ids or decoded are replaced; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    shared = spark.sparkContext.broadcast(dictionary(docs.select(text), path, entries))
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded", text_col.lower())]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    inner = docs.select(rest.alias("doc"), text)
    schema = T.StructType([inner.schema["doc"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, shared.value)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(sizes // PORTION, append=-1)) + 1
            for i, j in zip([0, *ends], ends):
                part = batch.slice(i, j - i)
                ids = tool.encode([t.encode() for t in part.column("text").to_pylist()])
                decoded = tool.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc", "ids", "decoded"]
                )

    out = inner.mapInArrow(each, schema)
    return out.select("doc.*", "ids", "decoded") if kept else out.select("ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode`` gave."""
    return encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
