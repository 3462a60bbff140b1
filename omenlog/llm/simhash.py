"""SimHash near-duplicates: fingerprints linked through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.llm.components import components
from omenlog.session import checkpointed

RADIUS = 3
SHINGLE = 3
#: Shingles are counted in blocks of so many, so that a very long text needs no more memory.
BLOCK = 1 << 16
#: Above so many fingerprints a bucket is split by a second family of masks.
BUCKET = 1024


def fingerprint(text: str | None) -> int:
    """64 bits, bit i set if it is set in over half the hashes of the text's 3-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n].tolist(), ends[len(ends) - n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pieces = zip(first[at: at + BLOCK], last[at: at + BLOCK])
        hashes = np.array([digest(joined[i:j], 42) for i, j in pieces], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed long."""
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return F.pandas_udf(each, "long")(text)


def covering_masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them are all clear in one.

    Each position i gets a vector phi(i) of radius + 1 bits; the mask of a vector v > 0 holds the
    positions whose phi has an odd inner product with v.  The phi of ``radius`` positions span
    less than the whole space, so some v is orthogonal to all of them and its mask avoids them
    all: two values that differ only there agree under that mask.
    """
    vectors = range(1, 1 << (radius + 1))
    order = np.random.default_rng(seed).permutation(len(bits))
    phi = {bits[int(i)]: vectors[k % len(vectors)] for k, i in enumerate(order)}
    return [sum(1 << i for i in bits if bin(phi[i] & v).count("1") % 2) for v in vectors]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def families(radius: int = RADIUS) -> tuple[list[int], list[list[int]]]:
    """The masks over all 64 bits, and for each one a second family over the bits it leaves out."""
    top = covering_masks(list(range(64)), radius, seed=7)
    return top, [covering_masks([i for i in range(64) if not m >> i & 1], radius, seed=11 + k) for k, m in enumerate(top)]


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what lies within ``radius`` of each other: a spanning forest, not all pairs.

    Breadth-first from each unreached value, one comparison of the value with all unreached ones.
    """
    left, out = np.unique(prints), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(np.bitwise_xor(left.view(np.uint64), np.int64(x).view(np.uint64))) <= radius
            out += [(int(x), int(y)) for y in left[near]]
            front += list(left[near])
            left = left[~near]
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links whose closure joins all fingerprints (column ``fp``, distinct) within the radius.

    Every fingerprint enters one table per mask.  Buckets are counted first (partial counts);
    single ones drop out.  A bucket above ``BUCKET`` is dealt again by the second family of its
    mask, which covers every pair within the radius among the bits left open: about 16 bits stay
    open then, so no bucket can exceed some 65,536 distinct values however hot its key is.  A
    bucket gives a spanning forest of its links.
    """
    top, second = families(radius)
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(top)])
    dealt = checkpointed(prints.select("fp", F.explode(table).alias("e")).select("fp", "e.t", "e.k"))
    sizes = checkpointed(dealt.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = checkpointed(dealt.join(sizes, ["t", "k"]))
    plain = shared.filter(F.col("n") <= BUCKET).select("fp", "t", "k", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("k2"))
    finer = F.array(*[
        F.array(*[F.struct(F.lit(j).alias("t2"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k2")) for j, m in enumerate(masks)])
        for masks in second
    ])
    split = shared.filter(F.col("n") > BUCKET).select("fp", "t", "k", F.explode(finer[F.col("t")]).alias("e")).select(
        "fp", "t", "k", "e.t2", "e.k2"
    )

    def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [pair for fps in batch["fps"] for pair in forest(np.asarray(fps, dtype=np.int64), radius)]
            yield pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    buckets = plain.unionByName(split).groupBy("t", "k", "t2", "k2").agg(F.collect_list("fp").alias("fps"))
    return buckets.filter(F.size("fps") > 1).select("fps").mapInPandas(spanning, "a long, b long")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root`` for each distinct fingerprint of ``docs`` (column ``fp``): root names its component."""
    prints = checkpointed(docs.select("fp").distinct())
    linked = components(links(prints, radius))
    return prints.join(linked, prints["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, n_same: one row for each row of ``docs``.

    Texts with equal fingerprints are one node, however many copies there are; n_same counts them.
    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    Null and empty texts and texts without words have fingerprint 0, and link like any other; null
    ids are left out of the smallest id (null if a component has no other); repeated rows stay;
    an empty table gives an empty result; other columns are not read.
    """
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    per_print = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same"))
    named = checkpointed(classes(rows, radius).join(per_print, "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    looked = named.join(ids, "root").select("fp", "component_id", "n_same")
    return rows.join(looked, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same"
    )


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, all columns kept.

    The smallest (id, hash of the text) of a component stays, ids before null.
    """
    mark = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    rows = checkpointed(docs.select(mark.alias("mark"), fingerprints(F.col(text_col)).alias("fp")))
    per_mark = rows.groupBy("fp", "mark").agg(F.count("*").alias("n"))
    per_print = per_mark.groupBy("fp").agg(F.min(F.struct("mark", "n")).alias("first"))
    chosen = classes(rows, radius).join(per_print, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = checkpointed(chosen.select(
        F.col("first.mark.id").alias("kept_id"), F.col("first.mark.h").alias("kept_h"), F.col("first.n").alias("n")))
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("whole_id"), F.xxhash64(text_col).alias("whole_h"))
    same = whole["whole_id"].eqNullSafe(chosen["kept_id"]) & (whole["whole_h"] == chosen["kept_h"])
    kept = whole.join(chosen, same)
    # Rows that repeat id and text are one document; only such rows are moved a second time.
    once = kept.filter("n = 1").select("doc")
    repeated = kept.filter("n > 1").dropDuplicates(["kept_id", "kept_h"]).select("doc")
    return once.unionByName(repeated).select("doc.*")
