"""Neighbour graphs: building, degrees, breadth-first distances, medoids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.functions import vectors as V
from tierscope.operators.knn import exact_knn
from tierscope.plans.session import cut


def knn_graph(base: DataFrame, degree: int) -> DataFrame:
    """(src, pos, dst): each node's nearest other nodes, nearest first.

    A stand-in for a built proximity graph. It compares all nodes in blocks;
    large corpora read a built index through ``sources`` instead.
    """
    near = exact_knn(base, base.select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec")), degree + 1)
    near = near.where("query_id <> node_id")
    w = W.partitionBy("query_id").orderBy("dist", "node_id")
    near = near.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < degree)
    return near.select(F.col("query_id").alias("src"), F.col("pos").cast("long").alias("pos"), F.col("node_id").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node_id, degree, nbrs from (src, pos, dst)."""
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("x"))
    return lists.select(F.col("src").alias("node_id"), F.size("x").alias("degree"), F.col("x.dst").alias("nbrs"))


def edges_of(adj: DataFrame) -> DataFrame:
    """(src, pos, dst); only the first ``degree`` slots of a list are valid."""
    return adj.select(F.col("node_id").alias("src"), "degree", F.posexplode("nbrs").alias("pos", "dst")).where("pos < degree").drop("degree")


def neighbors_of(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of the nodes in ``ids`` (node_id)."""
    return edges_of(adj.join(ids, "node_id", "left_semi"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree; nodes without incoming edges have 0."""
    counts = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("in_degree"))


def medoid(base: DataFrame, dims: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The node nearest to the mean (rounded to 6 digits), per key if any."""
    mean = base.groupBy(*keys).agg(F.array(*[F.round(F.avg(F.col("vec")[i]), 6) for i in range(dims)]).alias("mean"))
    pairs = base.join(F.broadcast(mean), list(keys)) if keys else base.crossJoin(F.broadcast(mean))  # one row per key
    scored = pairs.withColumn("d", V.l2_sq(F.col("vec"), F.col("mean"), dims))
    return scored.groupBy(*keys).agg(F.min_by(F.struct("node_id", "vec", "d"), F.struct("d", "node_id")).alias("m")).select(*keys, "m.node_id", "m.vec", F.col("m.d").alias("dist"))


def hop_distance(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node_id, hop: steps from the nearest of ``sources`` (node_id); nodes that
    can't be reached get one more than the farthest that can.

    One join and one anti-join a level; each level is cut, so a lost executor
    repeats one level only.
    """
    frontier = cut(sources.select("node_id").distinct().join(nodes, "node_id", "left_semi").withColumn("hop", F.lit(0).cast("long")))
    reached, level = frontier, 0
    while True:
        level += 1
        step = frontier.join(edges, frontier["node_id"] == edges["src"]).select(F.col("dst").alias("node_id")).distinct()
        frontier = cut(step.join(reached, "node_id", "left_anti").withColumn("hop", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        reached = cut(reached.union(frontier))  # one table, however many levels
    return nodes.select("node_id").join(reached, "node_id", "left").select("node_id", F.coalesce("hop", F.lit(level).cast("long")).alias("hop"))


def robust_prune(base: DataFrame, candidates: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """(src, pos, dst): of each node's candidates (src, dst), nearest first, those
    that no candidate taken before is ``alpha`` times nearer to; at most ``degree``.

    The published pruning rule of proximity graphs, by squared distances: with
    alpha² the rule on distances. Candidate lists have a bounded length.
    """
    vec = base.select("node_id", "vec")
    rows = candidates.where("src <> dst").select("src", "dst").distinct()
    rows = rows.join(vec.withColumnRenamed("node_id", "dst"), "dst")
    lists = rows.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "vec"))).alias("near"))
    lists = lists.join(vec.select(F.col("node_id").alias("src"), "vec"), "src")

    def prune(batches):
        for pdf in batches:
            out: list[tuple[int, int, int]] = []
            for src, near, own in zip(pdf["src"], pdf["near"], pdf["vec"], strict=True):
                ids = np.array([x["dst"] for x in near], np.int64)
                v, p = np.array([x["vec"] for x in near], np.float64), np.array(own, np.float64)
                d = ((v - p) ** 2).sum(1)
                left, taken = np.lexsort((ids, d)), []
                while len(left) and len(taken) < degree:
                    best, left = left[0], left[1:]
                    taken.append(best)
                    left = left[alpha * alpha * ((v[left] - v[best]) ** 2).sum(1) > d[left]]
                out += [(src, i, int(ids[k])) for i, k in enumerate(taken)]
            yield pd.DataFrame(out, columns=["src", "pos", "dst"])

    return lists.mapInPandas(prune, "src long, pos long, dst long")


def pruned_graph(base: DataFrame, edges: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """A navigable graph from neighbour lists: candidates are a node's neighbours,
    their neighbours, and those that list it; pruned twice, as lists of nodes that
    many others list are pruned again after the reverse edges come in."""
    two = edges.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    one = cut(robust_prune(base, edges.select("src", "dst").union(two), degree, alpha))
    both = one.select("src", "dst").union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return robust_prune(base, both, degree, alpha)


def neighbor_closure(groupings: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, needs): groups that a group's members have neighbours in."""
    a = groupings.select(F.col("node_id").alias("src"), "group_id")
    b = groupings.select(F.col("node_id").alias("dst"), F.col("group_id").alias("needs"))
    return edges.join(a, "src").join(b, "dst").where("group_id <> needs").select("group_id", "needs").distinct()
