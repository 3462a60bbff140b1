"""Sub-word pieces of a learned vocabulary: the longest match from a word's start on, with offsets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omenlog.operators.surprise import SPECIALS, vocabulary
from omenlog.session import checkpointed

UNKNOWN = SPECIALS.index("[UNK]")
#: Most entries of a vocabulary that is sent to the workers, and most words whose pieces a worker remembers.
ENTRIES, REMEMBERED = 200_000, 100_000


def learned(df: DataFrame, text: str = "norm", *, size: int = 30_000, min_frequency: int = 2) -> DataFrame:
    """``id, piece``: the vocabulary of ``text`` and, after it, the letters of its words.

    With its letters a vocabulary cuts every word that has no other letters.  Special tokens keep
    their ids and match no text.
    """
    words = vocabulary(df, text, size=size, min_frequency=min_frequency).filter(F.col("id") >= len(SPECIALS))
    words = checkpointed(words.select(F.col("id").cast("long"), F.col("word").alias("piece")))
    letters = words.select(F.explode(F.split("piece", "")).alias("piece")).filter("piece <> ''").distinct()
    letters = letters.join(words.select("piece"), "piece", "left_anti")
    last = words.agg(F.coalesce(F.max("id"), F.lit(len(SPECIALS) - 1))).scalar()
    # As many rows as there are different letters in at most ``size`` words.
    return words.unionByName(letters.select((last + F.row_number().over(Window.orderBy("piece"))).alias("id"), "piece"))


class Trie:
    """Pieces by their letters; built on first use, so that only the entries travel to the workers."""

    def __init__(self, entries: Iterable[tuple[str, int]]):
        self.entries, self.root, self.seen = list(entries), None, {}

    def __getstate__(self):
        return {"entries": self.entries, "root": None, "seen": {}}

    def _build(self) -> dict:
        root: dict = {}
        for piece, number in self.entries:
            at = root
            for letter in piece:
                at = at.setdefault(letter, {})
            at[""] = number
        return root

    def cut(self, word: str) -> list[int]:
        """id, start and end of each piece, one after the other; one unknown piece if a letter has no match."""
        if word in self.seen:
            return self.seen[word]
        if self.root is None:
            self.root = self._build()
        out, start = [], 0
        while start < len(word):
            at, number, end = self.root, None, start
            for i in range(start, len(word)):
                at = at.get(word[i])
                if at is None:
                    break
                if "" in at:
                    number, end = at[""], i + 1
            if number is None:
                out = [UNKNOWN, 0, len(word)]
                break
            out += [number, start, end]
            start = end
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = out
        return out


def cut(tokens: Column, pieces: DataFrame) -> Column:
    """For each word of an array its pieces as an array of ``id, start, end`` (end is exclusive).

    ``pieces`` is ``id, piece`` and is sent to the workers: above 200,000 entries is an error.  A
    word with a letter that no piece covers is one unknown piece; the empty word has none; null
    arrays stay null and null words have no pieces.
    """
    rows = pieces.select("piece", "id").limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES:
        raise ValueError(f"more than {ENTRIES} pieces")
    trie = Trie((r["piece"], r["id"]) for r in rows)

    def run(lists: pa.Array) -> pa.Array:
        codes = lists.flatten().dictionary_encode()
        cuts = [trie.cut(w) for w in codes.dictionary.to_pylist()] + [[]]  # the last one: null words
        ends = np.concatenate([[0], np.cumsum([len(c) // 3 for c in cuts])]).astype(np.int32)
        flat = np.array([x for c in cuts for x in c], dtype=np.int32).reshape(-1, 3)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["id", "start", "end"])
        words = pa.ListArray.from_arrays(pa.array(ends), spans).take(pc.fill_null(codes.indices, len(cuts) - 1))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(at, words, mask=lists.is_null())

    return F.arrow_udf(run, "array<array<struct<id:int,start:int,end:int>>>")(tokens)
