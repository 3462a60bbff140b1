"""Exact top-k by inner product: no-random-access aggregation over sorted lists, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.llm.vectors import EVERY, best, matrix, valid

#: Most queries and candidates of a cell, and candidates whose lists are sorted at a time.
QUERIES, CANDIDATES, BLOCK = 4096, 16_384, 2048
#: How deep the sorted lists are read after each round, as a share of their length.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)


def number_type(queries: np.ndarray, rows: np.ndarray):
    """The fastest type in which every inner product of these whole numbers is exact."""
    top = max((abs(int(f(m))) for m in (queries, rows) if m.size for f in (np.min, np.max)), default=0)
    bound = top * top * max(1, queries.shape[1])
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object


class Lists:
    """The components of a block of rows as sorted lists, read by one cursor per list and end.

    The first half of the lists runs down from the largest value of a dimension (for queries with a
    positive component there), the second half up from its smallest.  ``unread`` marks the entries
    that no cursor has met, ``cursor`` is the last value read from each list: no unread entry is
    more favourable.  ``far`` is the other end of each list: no entry is less favourable.
    """

    def __init__(self, rows: np.ndarray):
        up = np.argsort(rows, axis=0, kind="stable")
        self.order = np.concatenate([up[::-1], up], axis=1)
        self.values = np.take_along_axis(np.concatenate([rows, rows], axis=1), self.order, axis=0)
        self.unread = np.ones(self.values.shape, rows.dtype)
        self.far, self.cursor, self.depth = self.values[-1], self.values[0], 0

    def advance(self, depth: int) -> np.ndarray:
        """Read all lists on to ``depth`` entries; what was read now, by row, and zeros."""
        rows, values = self.order[self.depth : depth], self.values[self.depth : depth]
        met = np.zeros_like(self.unread)
        np.put_along_axis(met, rows, values, axis=0)
        np.put_along_axis(self.unread, rows, 0, axis=0)
        self.cursor, self.depth = self.values[depth - 1], depth
        return met


class Leaders:
    """The k best resolved rows of each query so far; the k-th score bounds what an outsider needs."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.need = np.full(len(queries), -np.inf)
        self.read = self.entries = 0  # entries of sorted lists read, and held by the lists of the queries
        self.kept = [(np.zeros(0, queries.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)

    def add(self, q: int, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Resolve the scores of some rows for query ``q`` and keep the best, ties to smaller ids."""
        other = numbers != self.own[q]
        scores, ids, numbers = rows[other] @ self.queries[q], ids[other], numbers[other]
        old = self.kept[q]
        scores, ids, numbers = (np.concatenate(p) for p in zip(old, (scores, ids, numbers)))
        order = np.lexsort((numbers, ids, -scores))[: self.k]
        self.kept[q] = (scores[order], ids[order], numbers[order])
        if len(order) == self.k:
            self.need[q] = scores[order[-1]]


def search(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, k: int) -> Leaders:
    """The exact ``k`` best of ``rows`` for each query, all as whole numbers.

    Each block of rows is one set of sorted lists, which are read in rounds.  Every query keeps the
    sums of what was read of each row.  The unread rest of a row is at most the cursors and at least
    the far ends of its lists, which gives its upper and its lower bound.  A query stops when no
    more than ``k`` rows can still reach its k-th best lower bound (the leaders of earlier blocks
    count with their scores); only these are resolved.  Where equal scores keep more rows open, the
    lists are read to their end.  Numbers too large for exact sums in floating point are resolved
    without lists.  ``read`` and ``entries`` of the result tell how much of the lists was read.
    """
    kind = number_type(queries, rows)
    queries, rows = queries.astype(kind), rows.astype(kind)
    leaders = Leaders(queries, own, k)
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    for at in range(0, len(rows), BLOCK):
        part = slice(at, at + BLOCK)
        block, n = rows[part], len(rows[part])
        if kind in (np.float32, np.float64):
            open_ = _still_open(leaders, weights, block, numbers[part])
        else:
            open_ = np.ones((len(queries), n), dtype=bool)
        for q in range(len(queries)):
            found = np.flatnonzero(open_[q])
            if len(found):
                leaders.add(q, block[found], ids[part][found], numbers[part][found])
    return leaders


def _still_open(leaders: Leaders, weights: np.ndarray, block: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Read the lists of a block until every query has stopped; the rows that it has to resolve."""
    n, k = len(block), leaders.k
    lists = Lists(block)
    result = np.zeros((len(weights), n), dtype=bool)
    at, itself = np.nonzero(leaders.own[:, None] == numbers[None, :])
    asked = np.arange(len(weights))
    seen = np.zeros((len(weights), n), block.dtype)
    used = np.count_nonzero(weights, axis=1)
    leaders.entries += int(used.sum()) * n
    for share in DEPTHS:
        depth = min(n, max(lists.depth + 1, int(np.ceil(share * n))))
        leaders.read += int(used[asked].sum()) * (depth - lists.depth)
        met = lists.advance(depth)
        seen += weights[asked] @ met.T
        most = seen + (weights[asked] * lists.cursor) @ lists.unread.T
        least = seen + (weights[asked] * lists.far) @ lists.unread.T if n > k else None
        mine = np.isin(asked, at)
        places = itself[np.searchsorted(at, asked[mine])]  # a query's own row is no candidate
        most[mine, places] = -np.inf
        need = leaders.need[asked]
        if least is not None:
            least[mine, places] = -np.inf
            need = np.maximum(need, np.partition(least, n - k, axis=1)[:, n - k])
        open_ = most >= need[:, None].astype(block.dtype)
        open_[mine, places] = False
        stops = (open_.sum(axis=1) <= k) if depth < n else np.ones(len(asked), dtype=bool)
        result[asked[stops]] = open_[stops]
        if stops.all():
            break
        asked, seen = asked[~stops], seen[~stops]
    return result


def top_k(vectors: DataFrame, k: int = 20, *, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the exact ``k`` best rows by integer inner product.

    Each component x becomes floor(scale * x).  Rows whose id is divisible by 20 are the queries,
    every row but the query's own is a candidate.  Queries and candidates are dealt by hash into a
    grid of cells of bounded size; a cell reads the sorted lists of blocks of its candidates in rounds, and the
    k best of each cell meet per query (ranked before and after the shuffle).

    Vectors that are null or hold null or non-finite components, and null ids, take no part;
    shorter vectors count as filled up with zeros; repeated rows are candidates and queries of
    their own; ties go to the smaller vec_id; with fewer candidates than k all are given; an
    empty table gives an empty result; a score beyond 64 bits is an error; other columns are not read.
    """
    rows = valid(vectors, id_col, vector_col, F.transform("v", lambda c: F.floor(c * scale).cast("long")))
    asked = rows.filter(F.col("vec_id") % EVERY == 0)
    sizes = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width, n_q = sizes[1] or 0, asked.count()
    across, down = max(3, -(-n_q // QUERIES)), max(8, -(-sizes[0] // CANDIDATES))
    deal = F.xxhash64("row", F.lit(3))
    candidates = rows.withColumn("c", F.pmod(deal, F.lit(down)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    queries = asked.withColumn("q", F.pmod(deal, F.lit(across)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

    def cell(both: pd.DataFrame) -> pd.DataFrame:
        asked, held = both[both["asks"]], both[~both["asks"]]
        if asked.empty or held.empty:
            return pd.DataFrame({"query": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")
        found = search(
            matrix(asked["v"], width, np.int64), asked["row"].to_numpy(), matrix(held["v"], width, np.int64),
            held["vec_id"].to_numpy(), held["row"].to_numpy(), k,
        ).kept
        lengths = [len(s) for s, _, _ in found]
        joined = [np.concatenate([f[i] for f in found]) for i in range(3)]
        return pd.DataFrame({
            "query": np.repeat(asked["row"].to_numpy(), lengths), "query_id": np.repeat(asked["vec_id"].to_numpy(), lengths),
            "row": joined[2], "vec_id": joined[1], "score": [int(s) for s in joined[0]],
        }).astype("int64")

    both = queries.withColumn("asks", F.lit(True)).unionByName(candidates.withColumn("asks", F.lit(False)))
    found = both.groupBy("q", "c").applyInPandas(cell, "query long, query_id long, row long, vec_id long, score long")
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 20, scale: int = 64) -> str:
    """The same for DuckDB, by brute force."""
    return f"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {k}
    """
