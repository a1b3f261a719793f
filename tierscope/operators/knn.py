"""Exact nearest neighbours by squared distance; ties go to the smaller id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.functions import vectors as V

#: Queries that go to the executors at once; rows of the base in a block.
QUERY_BLOCK, BASE_BLOCK = 4_000, 16_000


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), dist: str = "dist") -> DataFrame:
    """The k least rows of each key, as rank 0.. (partial top-k before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(dist, "node_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("long"))


def knn_sql(base: DataFrame, queries: DataFrame, k: int, dims: int | None = None, expanded: bool = False) -> DataFrame:
    """Every pair as an expression, for query sets of at most QUERY_BLOCK rows."""
    if (n := queries.count()) > QUERY_BLOCK:
        raise ValueError(f"{n} queries: use the blocked strategy")
    pairs = base.crossJoin(F.broadcast(queries.limit(QUERY_BLOCK)))
    dist = V.l2_expanded(F.col("qvec"), F.col("vec")) if expanded else V.l2_sq(F.col("qvec"), F.col("vec"), dims)
    return top_k(pairs.select("query_id", "node_id", dist.alias("dist")), k)


class Squared:
    """Squared distances of vectors. One product of matrices finds the candidates,
    with room for its rounding; theirs are then added from left to right."""

    kind = np.float64

    def near(self, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (q * q).sum(1), (v * v).sum(1)
        return a[:, None] + b - 2 * (q @ v.T), 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (a + b.max())

    def exact(self, q: np.ndarray, v: np.ndarray, near: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for lo in range(0, len(r), 20_000):
            d = q[r[lo : lo + 20_000]] - v[c[lo : lo + 20_000]]
            out[lo : lo + 20_000] = (d * d).cumsum(1)[:, -1]
        return out


class Coded:
    """Distances by codes: a query's flat table (chunk * centroids + code), added
    over the chunks from left to right."""

    kind = np.int64

    def __init__(self, centroids: int):
        self.centroids = centroids

    def near(self, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
        table = np.ascontiguousarray(q.T)
        out = table[v[:, 0]]
        for c in range(1, v.shape[1]):
            out += table[v[:, c] + c * self.centroids]
        return np.ascontiguousarray(out.T), 0.0

    def exact(self, q: np.ndarray, v: np.ndarray, near: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return near[r, c]


class _Best:
    """The k nearest of all rows of the base seen so far, for a block of queries."""

    FREE = np.iinfo(np.int64).max

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, how: Squared | Coded):
        self.ids, self.q, self.k, self.how = ids, q, k, how
        self.node, self.dist = np.full((len(q), k), self.FREE), np.full((len(q), k), np.nan)  # nan is last

    def add(self, nodes: np.ndarray, v: np.ndarray) -> None:
        for lo in range(0, len(self.q), 256):
            q, limit = self.q[lo : lo + 256], self.dist[lo : lo + 256, -1]
            near, room = self.how.near(q, v)
            if len(v) >= self.k and np.isnan(limit).any():
                limit = np.fmin(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
            r, c = np.nonzero(~(near > (limit + room)[:, None]))
            if len(r):
                self._merge(lo, r, nodes[c], self.how.exact(q, v, near, r, c))

    def _merge(self, lo: int, r: np.ndarray, node: np.ndarray, dist: np.ndarray) -> None:
        rows, at = np.unique(r, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        node, dist = np.concatenate([self.node[lo + rows].ravel(), node]), np.concatenate([self.dist[lo + rows].ravel(), dist])
        order = np.lexsort((node, dist, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        order = order[first[:, None] + np.arange(self.k)]
        self.node[lo + rows], self.dist[lo + rows] = node[order], dist[order]

    def rows(self) -> pd.DataFrame:
        there = self.node.ravel() != self.FREE
        return pd.DataFrame({"query_id": np.repeat(self.ids, self.k)[there], "node_id": self.node.ravel()[there], "dist": self.dist.ravel()[there]})


_NEAR = "query_id long, node_id long, dist double"


def _add(best: _Best, pdf: pd.DataFrame) -> None:
    for lo in range(0, len(pdf), 2_000):
        part = pdf.iloc[lo : lo + 2_000]
        best.add(part["node_id"].to_numpy(), np.stack(part["vec"].to_numpy()).astype(best.how.kind))


def knn_blocked(base: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK, how: Squared | Coded | None = None) -> DataFrame:
    """Blocks of queries against Arrow batches of the base.

    Each task keeps its k best per query and sends only those. Up to ``block``
    queries are broadcast. More are cut into blocks, as is the base, and each
    pair of blocks is a group of its own in the executors: nothing passes through
    the driver, and a group has a bounded size however many rows there are. As
    each block is sent to all of the other side's, those of queries hold four times
    as many there. ``how`` scores qvec against vec (default: squared distance).
    """
    spark, how = base.sparkSession, how or Squared()
    total = queries.count()
    if total > block:
        n, m = -(-total // (4 * block)), max(1, -(-base.count() // base_block))
        cell = lambda key, parts, other: [F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))]
        mine, everywhere = cell("query_id", n, m)
        q = queries.select("query_id", "qvec", mine.alias("i"), everywhere.alias("j"))
        mine, everywhere = cell("node_id", m, n)
        b = base.select("node_id", "vec", mine.alias("j"), everywhere.alias("i"))

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "node_id": np.zeros(0, np.int64), "dist": np.zeros(0)})
            best = _Best(left["query_id"].to_numpy(), np.stack(left["qvec"].to_numpy()).astype(np.float64), k, how)
            _add(best, right)
            return best.rows()

        return top_k(q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(pair, _NEAR), k)
    rows = queries.select("query_id", "qvec").toArrow()  # at most ``block`` query vectors
    if not len(rows):
        return spark.createDataFrame([], f"{_NEAR}, rank long")
    vecs = rows["qvec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(rows), -1)
    shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), vecs))

    def search(batches):
        best = _Best(*shared.value, k, how)
        for pdf in batches:
            _add(best, pdf)
        yield best.rows()

    return top_k(base.select("node_id", "vec").mapInPandas(search, _NEAR), k)


def exact_knn(base: DataFrame, queries: DataFrame, k: int, strategy: str = "blocked", dims: int | None = None) -> DataFrame:
    """query_id, node_id, dist, rank; strategy: blocked, unrolled or sql."""
    if strategy == "blocked":
        out = knn_blocked(base, queries, k)
    elif strategy in ("unrolled", "sql"):
        out = knn_sql(base, queries, k, dims if strategy == "unrolled" else None)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return out.select("query_id", "node_id", "dist", "rank")


def self_test(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Two results compared: queries whose id sets and k-th distances differ,
    and the largest difference of distances of the same rank."""
    per = lambda d, n: d.groupBy("query_id").agg(F.array_sort(F.collect_list("node_id")).alias(f"ids_{n}"), F.max("dist").alias(f"far_{n}"))
    both = per(a, "a").join(per(b, "b"), "query_id", "full_outer")
    bad = F.coalesce((F.col("ids_a") != F.col("ids_b")) & (F.abs(F.col("far_a") - F.col("far_b")) > tolerance), F.lit(True))
    ranks = a.select("query_id", "rank", F.col("dist").alias("da")).join(b.select("query_id", "rank", F.col("dist").alias("db")), ["query_id", "rank"])
    return both.agg(F.sum(bad.cast("long")).alias("mismatches"), F.count("*").alias("queries")).crossJoin(ranks.agg(F.max(F.abs(F.col("da") - F.col("db"))).alias("max_diff")))
