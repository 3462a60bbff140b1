"""Approximate nearest neighbours: balanced posting lists, replicated borders, a graph over centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.llm.common import share
from omenlog.llm.vectors import EVERY, best, matrix, valid
from omenlog.session import checkpointed

#: The index is fitted on a sample of about so many vectors; every vector is indexed.
FIT_ROWS = 16_384
#: Vectors of a list on average, fewest and most lists.
LIST, FEWEST, MOST = 256, 4, 1024
#: Lists that hold a vector at most, and how much farther than the nearest centroid they may be.
COPIES, CLOSURE = 2, 0.1
#: Neighbours of a centroid in the graph.
EDGES = 16
#: Share of true neighbours in the sample that the distance ratio must reach.
AIM = 0.95
#: Rows of a list part and queries of a cell at most.
PART, QUERIES = 16_384, 4096


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def balanced_centroids(points: np.ndarray, lists: int, norm: float, rounds: int = 12) -> np.ndarray:
    """Lloyd's iteration on a sphere, in which a list pays for being larger than the mean."""
    draw = np.random.default_rng(13)
    centroids = points[draw.choice(len(points), lists, replace=False)].copy()
    fee = np.zeros(lists)
    for _ in range(rounds):
        cost = _distances(points, centroids) ** 2
        nearest = np.argmin(cost + fee, axis=1)
        sizes = np.bincount(nearest, minlength=lists)
        fee += 0.2 * cost.min(axis=1).mean() * np.clip(sizes * lists / len(points) - 1, -1, 2)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        length = np.sqrt((sums * sums).sum(axis=1))
        lost = (sizes == 0) | (length < 1e-12 * norm)
        centroids = sums * (norm / np.where(lost, 1, length))[:, None]
        if lost.any():  # start again in the largest lists
            centroids[lost] = points[np.argsort(-sizes[nearest], kind="stable")[: lost.sum()]]
    return centroids


@dataclass
class Index:
    """Centroids with their neighbour graph; vectors are lifted so that the largest inner product is nearest."""

    width: int
    norm: float
    centroids: np.ndarray
    graph: np.ndarray
    ratio: float = 0.0

    @staticmethod
    def fit(sample: np.ndarray, norm: float, rows: int) -> Index:
        """Centroids, graph and the distance ratio that finds the sample's own neighbours."""
        index = Index(sample.shape[1], norm, np.zeros((0, sample.shape[1] + 1)), np.zeros((0, 0), bool))
        points = np.unique(index.lifted(sample), axis=0)
        lists = int(min(max(FEWEST, rows // LIST), MOST, len(points)))
        index.centroids = balanced_centroids(points, lists, norm)
        apart = _distances(index.centroids, index.centroids)
        near = np.argsort(apart, axis=1, kind="stable")[:, 1: EDGES + 1]
        graph = np.zeros((lists, lists), dtype=bool)
        graph[np.repeat(np.arange(lists), near.shape[1]), near.ravel()] = True
        graph[np.arange(lists), (np.arange(lists) + 1) % lists] = True  # a ring: every centroid can be reached
        index.graph = graph | graph.T
        asked = sample[:: max(1, len(sample) // 256)][:256]
        index.ratio = index.calibrated(asked, sample)
        return index

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more component gives all vectors the same norm; their distances follow the inner product."""
        rest = np.maximum(self.norm**2 - (x * x).sum(axis=1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries have no further component; their length does not matter and is made the common one."""
        length = np.sqrt((q * q).sum(axis=1))
        return np.concatenate([q * (self.norm / length)[:, None], np.zeros((len(q), 1))], axis=1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs: the nearest list, and for border vectors up to ``COPIES`` lists.

        A further list is taken if its centroid is at most ``CLOSURE`` farther than the nearest.
        """
        far = _distances(self.lifted(x), self.centroids)
        order = np.argsort(far, axis=1, kind="stable")[:, :COPIES]
        near = np.take_along_axis(far, order, axis=1)
        who, slot = np.nonzero(near <= (1 + CLOSURE) * near[:, :1])
        return who, order[who, slot]

    def probes(self, q: np.ndarray, sizes: np.ndarray, least: int, ratio: float | None = None) -> np.ndarray:
        """Which lists each query reads: (queries, lists).

        The search walks the graph from a few entries and opens every centroid reached whose
        distance is at most (1 + ratio) times the least found so far; these are the lists.  If
        they hold fewer than ``least`` entries, the next nearest lists follow.
        """
        ratio = self.ratio if ratio is None else ratio
        q, n = self.asked(q), len(self.centroids)
        far = np.full((len(q), n), np.inf)
        opened = np.zeros((len(q), n), dtype=bool)
        fresh = np.zeros((len(q), n), dtype=bool)
        fresh[:, :: max(1, n // 8)] = True
        steps = self.graph.astype(np.float32)
        while fresh.any():
            who, c = np.nonzero(fresh)
            far[who, c] = np.sqrt(np.maximum(((q[who] - self.centroids[c]) ** 2).sum(axis=1), 0))
            go = (far <= (1 + ratio) * far.min(axis=1)[:, None]) & ~opened
            best_one = far.argmin(axis=1)
            opened |= go
            opened[np.arange(len(q)), best_one] = True
            fresh = ((go.astype(np.float32) @ steps) > 0) & np.isinf(far)
        chosen = far <= (1 + ratio) * far.min(axis=1)[:, None]
        short = np.flatnonzero(chosen @ sizes < least)
        if len(short):
            order = np.argsort(_distances(q[short], self.centroids), axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) - sizes[order] < least
            for i, s in enumerate(short):
                chosen[s, order[i][enough[i]]] = True
        return chosen

    def calibrated(self, asked: np.ndarray, sample: np.ndarray, k: int = 20) -> float:
        """The least ratio at which ``AIM`` of the sample's true neighbours lie in a list that is read."""
        if not len(asked):
            return 0.0
        who, lists = self.homes(sample)
        holds = np.zeros((len(sample), len(self.centroids)), dtype=bool)
        holds[who, lists] = True
        far = _distances(self.asked(asked), self.centroids)
        near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : k + 1]
        needed = [np.where(holds[near[i]], far[i], np.inf).min(axis=1) / max(far[i].min(), 1e-12) for i in range(len(asked))]
        return float(max(0.0, np.quantile(np.concatenate(needed), AIM) - 1 + 1e-9))


def nearest_in(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, k: int):
    """The k + 1 best rows of each query: (query position, row position), equal vectors by smallest id.

    Products of a whole block only preselect (with room for rounding); the score of what is
    returned is summed component by component, so equal vectors have equal scores everywhere.
    """
    order = np.lexsort((numbers, ids))
    rows, back = rows[order], order
    unique, which = np.unique(rows, axis=0, return_inverse=True)
    which = which.ravel()
    by = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[by], np.arange(len(unique) + 1))
    products = queries @ unique.T
    at = max(0, len(unique) - k - 1)
    room = 1e-9 * np.abs(products).max(initial=1.0)
    least = np.partition(products, at, axis=1)[:, at] - room
    for q in range(len(queries)):
        good = np.flatnonzero(products[q] >= least[q])
        exact = (unique[good] * queries[q]).sum(axis=1)
        members = [by[starts[u]: min(starts[u] + k + 1, starts[u + 1])] for u in good]
        scores = np.repeat(exact, [len(m) for m in members])
        found = np.concatenate(members)
        best_of = np.lexsort((found, -scores))[: k + 1]  # rows are in the order of ids
        yield q, back[found[best_of]], scores[best_of]


def nearest(vectors: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found, by largest inner product.

    The index is fitted on a bounded sample; then every vector goes to its list, border vectors to
    up to ``COPIES``.  Rows whose id is divisible by 20 are the queries: each searches the centroid
    graph and reads the lists within the fitted distance ratio.  List parts and queries are dealt
    into cells of bounded size (a list above ``PART`` rows is split, so a hot vector does not make
    a hot task), and the best of each cell meet per query.

    Vectors that are null, zero or hold null or non-finite components, and null ids, take no
    part; shorter vectors count as filled up with zeros; repeated rows are candidates and queries
    of their own; ties go to the smaller vec_id; with fewer candidates than k all are given; an
    empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col).filter(F.exists("v", lambda c: c != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    n, norm, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    if not n:
        return spark.range(0).selectExpr("id AS query_id", "CAST(id AS INT) AS rank", "id AS vec_id", "CAST(id AS DOUBLE) AS score")
    sample = rows.filter(share(F.col("row"), 5) < min(1.0, FIT_ROWS / n)).orderBy("row").select("v").toPandas()
    if sample.empty:
        sample = rows.limit(1).select("v").toPandas()
    index = Index.fit(matrix(sample["v"], width), float(norm) * (1 + 1e-12), n)
    lists = len(index.centroids)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at: at + 4096]
                who, where = index.homes(matrix(part["v"], width))
                yield part.iloc[who].assign(list=where)

    posted = checkpointed(rows.mapInPandas(home, "row long, vec_id long, v array<double>, list int"))
    sizes = np.zeros(lists, dtype=np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    parts = -(-sizes // PART)
    cells = max(24, int(-(-sizes.sum() // PART)))
    asked = rows.filter(F.col("vec_id") % EVERY == 0)
    groups = -(-asked.count() // QUERIES) or 1
    # The cell of a list part: at most MOST numbers are embedded here.
    split = F.element_at(F.array(*[F.lit(int(max(1, p))) for p in parts]), F.col("list") + 1)
    posted = posted.withColumn("part", F.pmod(F.xxhash64("row", F.lit(9)), split).cast("int"))
    posted = posted.withColumn("cell", F.pmod(F.xxhash64("list", "part"), F.lit(cells)).cast("int"))
    posted = posted.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                piece = batch.iloc[at: at + 1024]
                chosen = index.probes(matrix(piece["v"], width), sizes, (k + 1) * COPIES)
                yield piece.assign(lists=[np.flatnonzero(c).tolist() for c in chosen])

    schema = "row long, vec_id long, v array<double>, lists array<int>"
    probed = checkpointed(asked.mapInPandas(probe, schema))
    each = probed.select("row", F.explode("lists").alias("list")).withColumn("part", F.explode(F.sequence(F.lit(0), split - 1)))
    wanted = each.groupBy("row", F.pmod(F.xxhash64("list", "part"), F.lit(cells)).cast("int").alias("cell")).agg(
        F.collect_set("list").alias("lists"))
    queries = probed.select("row", "vec_id", "v").join(wanted, "row").withColumn(
        "grp", F.pmod(F.xxhash64("row", F.lit(4)), F.lit(groups)).cast("int"))

    def cell(both: pd.DataFrame) -> pd.DataFrame:
        asked, held = both[both["list"] < 0], both[both["list"] >= 0]
        out = {name: [] for name in ("query", "query_id", "row", "vec_id", "score")}
        if len(asked) and len(held):
            q, x = matrix(asked["v"], width), matrix(held["v"], width)
            own, own_id = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
            number, ids, home_of = held["row"].to_numpy(), held["vec_id"].to_numpy(), held["list"].to_numpy()
            reads = np.zeros((len(q), lists), dtype=bool)
            for i, chosen in enumerate(asked["lists"]):
                reads[i, chosen] = True
            for one in np.unique(home_of):
                at, who = np.flatnonzero(home_of == one), np.flatnonzero(reads[:, one])
                if not len(who):
                    continue
                for i, found, scores in nearest_in(q[who], x[at], ids[at], number[at], k):
                    keep = number[at][found] != own[who[i]]
                    out["query"].append(np.full(keep.sum(), own[who[i]]))
                    out["query_id"].append(np.full(keep.sum(), own_id[who[i]]))
                    out["row"].append(number[at][found][keep])
                    out["vec_id"].append(ids[at][found][keep])
                    out["score"].append(scores[keep])
        frame = pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()})
        frame = frame.astype({"query": "int64", "query_id": "int64", "row": "int64", "vec_id": "int64", "score": "float64"})
        frame = frame.drop_duplicates(["query", "row"]).sort_values(["query", "score", "vec_id", "row"], ascending=[True, False, True, True])
        return frame.groupby("query").head(k)

    queries = queries.select("row", "vec_id", "v", "cell", "grp", "lists", F.lit(-1).alias("list"))
    none = F.lit(None).cast("array<int>")
    both = queries.unionByName(posted.select("row", "vec_id", "v", "cell", "grp", none.alias("lists"), "list"))
    found = both.groupBy("cell", "grp").applyInPandas(cell, "query long, query_id long, row long, vec_id long, score double")
    once = found.dropDuplicates(["query", "row"])
    return best(once, k).select("query_id", "rank", "vec_id", "score")
