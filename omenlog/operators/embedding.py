"""Default embedding of lines: hashed words, inverse document frequency, principal components.

The numbers are those of Spark ML's ``HashingTF``, ``IDF`` and ``PCA``, which cut and hash the words anew
for each of their passes.  Here one pass adds up the products of the word counts, whole numbers that the
frequencies scale afterwards, and a second one projects the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.operators import positions as moves

#: Lines whose counts are a dense matrix at once.
LINES = 1024
#: Rows of the matrix of products in one cell.
STRIPE = 64
SEED = 42  # of the hashes of ``HashingTF``


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint32(by)) | (h >> np.uint32(32 - by))


def murmur3(texts: pa.Array) -> np.ndarray:
    """The 32-bit Murmur3 hashes of texts in UTF-8."""
    data, size = moves.flat_bytes(texts)
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    at = np.cumsum(size) - size

    def mixed(k: np.ndarray) -> np.ndarray:
        return _turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    def four(at: np.ndarray) -> np.ndarray:
        return data[at] | data[at + 1] << np.uint32(8) | data[at + 2] << np.uint32(16) | data[at + 3] << np.uint32(24)

    h = np.full(len(size), SEED, dtype=np.uint32)
    rows, done = np.flatnonzero(size >= 4), 0
    while len(rows):
        h[rows] = _turned(h[rows] ^ mixed(four(at[rows] + done)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        done += 4
        rows = rows[size[rows] >= done + 4]
    tail = size % 4
    h ^= mixed(four(at + size - tail) & ((np.uint32(1) << (8 * tail).astype(np.uint32)) - np.uint32(1)))
    h ^= size.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return h ^ (h >> np.uint32(16))


def counts(lists: pa.Array, features: int) -> Iterator[np.ndarray]:
    """How often each hashed word is in each line, for so many ``LINES`` at a time."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    feature = murmur3(coded.dictionary).view(np.int32).astype(np.int64) % features
    feature = feature[coded.indices.to_numpy()]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for low in range(0, len(sizes), LINES):
        n = min(LINES, len(sizes) - low)
        line = np.repeat(np.arange(n), sizes[low:low + n])
        cells = line * features + feature[ends[low]:ends[low + n]]
        yield np.bincount(cells, minlength=n * features).reshape(n, features)


def _products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of whole numbers, exactly: by floats if they hold the largest sum, which stands in the diagonal."""
    y = x.astype(np.float64)
    if np.einsum("ij,ij->j", y, y).max(initial=0) < 1 << 24:
        y = x.astype(np.float32)
    return (y.T @ y).astype(np.int64)


def fitted(lines: DataFrame, features: int, components: int) -> np.ndarray:
    """What the counts of a line's hashed words are multiplied with to give its components."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, held = 0, np.zeros(features, np.int64), np.zeros(features, np.int64)
        gram = np.zeros((features, features), np.int64)
        for table in moves.tables(batches):
            n += len(table)
            for x in counts(table["words"].chunk(0), features):
                total += x.sum(axis=0)
                held += (x > 0).sum(axis=0)
                gram += _products(x)
        if n:
            # the sums stand beside the first stripe
            cells = [(-1, np.concatenate([[n], total, held]))]
            cells += [(i, gram[i:i + STRIPE].ravel()) for i in range(0, features, STRIPE)]
            yield moves._rows([(i, moves._packed(sums=moves._small(c))) for i, c in cells])

    def joined(table: pa.Table) -> pa.Table:
        sums = 0
        for block in table["block"]:
            sums = sums + moves._unpacked(block)["sums"].astype(np.int64)
        return pa.Table.from_batches([moves._rows([(table["part"][0].as_py(), moves._packed(sums=sums))])])

    cells = lines.select(F.col("norm").alias("words")).mapInArrow(add_up, moves.MOVED)
    found = cells.groupBy("part").applyInArrow(joined, moves.MOVED).collect()
    if not found:
        return np.zeros((features, components))
    found = {r["part"]: moves._unpacked(pa.scalar(bytes(r["block"]), pa.binary()))["sums"] for r in found}
    sums = found.pop(-1)
    n, total, held = int(sums[0]), sums[1:features + 1], sums[features + 1:]
    gram = np.concatenate([found[i] for i in sorted(found)]).reshape(features, features)
    idf = np.log((n + 1) / (held + 1))
    mean = idf * total / n
    covariance = (idf[:, None] * idf * gram - n * np.outer(mean, mean)) / max(n - 1, 1)
    axes = np.linalg.svd(covariance)[0][:, :components]
    return idf[:, None] * axes


def embedded(lines: DataFrame, features: int = 1024, components: int = 16) -> DataFrame:
    """Default embedding ``vec`` beside distinct lines.

    The fit keeps a ``features`` x ``features`` matrix in each task, so ``features`` stays in the low thousands.
    It reads the lines and so does the projection: they should be a written table.
    """
    axes = fitted(lines, features, components)

    def project(texts: pa.Array) -> pa.Array:
        vectors = [np.zeros((0, components)), *(x @ axes for x in counts(moves.split(texts), features))]
        flat = np.concatenate(vectors).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * components), pa.array(flat))

    return lines.withColumn("vec", F.arrow_udf(project, "array<double>")(F.col("norm")))
