"""Beam search over the part of a graph that a mask leaves, for many queries and
masks at once.

``bsp``: all (mask, query) pairs advance one hop per round of joins. The state
holds every node that a pair has discovered. As eviction always drops the worst
candidate and nothing comes back, the candidate list of size L is the L best of
the state, and the frontier the W best of those not yet expanded. Nothing is
collected or broadcast, so index and query set may be of any size.

``arrow``: the index is broadcast, after a check of its size, and each task runs
its pairs in memory.

Ties go to the smaller (distance, node_id) in both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.functions import vectors as V
from tierscope.operators.pq import CENTROIDS
from tierscope.plans.session import cut

#: Largest index, in bytes, that ``arrow`` broadcasts.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class SearchParams:
    L: int
    W: int
    k: int = 10
    io_limit: int | None = None


@dataclass
class Index:
    """The tables of an index: vec (node_id, vec), adj (node_id, degree, nbrs),
    codes (node_id, code), tables (query_id, adc), centroids per chunk."""

    vec: DataFrame
    adj: DataFrame
    codes: DataFrame
    tables: DataFrame
    dims: int
    centroids: int = CENTROIDS


def entry_of(queries: DataFrame, entries: DataFrame, dims: int) -> DataFrame:
    """(query_id, entry): the nearest entry point by exact distance; the first
    (by ``ord``) of equally near ones."""
    pairs = queries.crossJoin(F.broadcast(entries.select("ord", "node_id", "vec")))  # a few entry points
    d = V.l2_sq(F.col("qvec"), F.col("vec"), dims)
    return pairs.withColumn("d", d).groupBy("query_id").agg(F.min_by("node_id", F.struct("d", "ord")).alias("entry"), F.min("d").alias("entry_dist"))


def fallback_seeds(pred: DataFrame, hops: DataFrame | None) -> DataFrame:
    """(mask_id, seed): of the nodes with codes, the one fewest hops away."""
    if hops is None:
        raise ValueError("an entry point lacks codes and no hop distances were given")
    return pred.where("codes_ok").join(hops, "node_id").groupBy("mask_id").agg(F.min_by("node_id", F.struct("hop", "node_id")).alias("fallback"))


def seeds(entry: DataFrame, pred: DataFrame, hops: DataFrame | None) -> DataFrame:
    """(mask_id, query_id, seed, used_fallback): seed is null if a mask has no codes."""
    masks = pred.select("mask_id").distinct()
    pairs = entry.select("query_id", "entry").crossJoin(F.broadcast(masks))
    ok = pred.select("mask_id", F.col("node_id").alias("entry"), "codes_ok")
    pairs = pairs.join(ok, ["mask_id", "entry"], "left").withColumn("codes_ok", F.coalesce("codes_ok", F.lit(False)))
    if hops is None:
        if not pairs.where("NOT codes_ok").isEmpty():
            fallback_seeds(pred, None)
        return pairs.select("mask_id", "query_id", F.col("entry").alias("seed"), F.lit(False).alias("used_fallback"))
    pairs = pairs.join(F.broadcast(fallback_seeds(pred, hops)), "mask_id", "left")  # one row per mask
    return pairs.select("mask_id", "query_id", F.when(F.col("codes_ok"), F.col("entry")).otherwise(F.col("fallback")).alias("seed"), (~F.col("codes_ok")).alias("used_fallback"))


def _finish(state: DataFrame, index: Index, queries: DataFrame, pred: DataFrame, start: DataFrame, params: SearchParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hits, stats and expanded of a final state (mask, query, node, adc, hop)."""
    done = state.where("hop IS NOT NULL").join(pred.select("mask_id", "node_id", "adj_ok", "vec_ok"), ["mask_id", "node_id"])
    # once for each query and node, however many masks have them: vectors are wide
    exact = done.where("vec_ok").select("query_id", "node_id").distinct().join(index.vec.select("node_id", "vec"), "node_id").join(queries.select("query_id", "qvec"), "query_id")
    exact = done.where("vec_ok").join(exact.select("query_id", "node_id", V.l2_sq(F.col("qvec"), F.col("vec"), index.dims).alias("dist")), ["query_id", "node_id"])
    columns = ["mask_id", "query_id", "node_id", "hop", "adj_ok", "vec_ok"]
    scored = exact.select(*columns, "dist").union(done.where("NOT vec_ok").select(*columns, F.col("adc").alias("dist")))
    w = W.partitionBy("mask_id", "query_id").orderBy("dist", "node_id")
    hits = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= params.k)
    hits = hits.select("mask_id", "query_id", (F.col("rank") - 1).cast("long").alias("rank"), "node_id", "dist", F.col("vec_ok").alias("is_exact"))
    counts = done.groupBy("mask_id", "query_id").agg(F.countDistinct("hop").alias("hops"), F.count("*").alias("num_expanded"), F.count_if(~F.col("adj_ok")).alias("miss_count"), F.count_if(~F.col("vec_ok")).alias("code_only_count"))
    stats = start.select("mask_id", "query_id", "used_fallback").join(counts, ["mask_id", "query_id"], "left").na.fill(0)
    return hits, stats, done.select("mask_id", "query_id", "node_id", "hop")


def search_bsp(index: Index, queries: DataFrame, pred: DataFrame, start: DataFrame, params: SearchParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, stats, expanded) for every row of ``start``; see the module."""
    keys = ["mask_id", "query_id"]

    def scored(rows: DataFrame) -> DataFrame:
        both = rows.join(index.codes, "node_id").join(index.tables, "query_id")
        return both.select(*keys, "node_id", V.adc(F.col("code"), F.col("adc"), index.centroids).alias("adc"))

    state = scored(start.where("seed IS NOT NULL").select(*keys, F.col("seed").alias("node_id"))).withColumn("hop", F.lit(None).cast("long"))
    state, hop = cut(state), 0
    allowed = pred.where("codes_ok").select("mask_id", "node_id")
    best = W.partitionBy(*keys).orderBy("adc", "node_id")
    limit = params.io_limit if params.io_limit is not None else 1 << 60
    while True:
        hop += 1
        open_ = (F.col("rn") <= params.L) & F.col("hop").isNull()
        ranked = state.withColumns({"rn": F.row_number().over(best), "ios": F.count("hop").over(W.partitionBy(*keys))})
        ranked = ranked.withColumn("open", open_)
        turn = F.row_number().over(W.partitionBy(*keys, "open").orderBy("adc", "node_id"))
        go = F.col("open") & (turn <= params.W) & (F.col("ios") < limit)
        marked = cut(ranked.select(*keys, "node_id", "adc", F.when(go, F.lit(hop).cast("long")).otherwise(F.col("hop")).alias("hop")))
        frontier = marked.where(F.col("hop") == hop)
        if frontier.isEmpty():
            break
        reach = frontier.join(pred.where("adj_ok").select("mask_id", "node_id"), ["mask_id", "node_id"], "left_semi")
        near = reach.join(index.adj, "node_id").select(*keys, F.explode(F.slice("nbrs", F.lit(1), F.col("degree"))).alias("node_id")).distinct()
        new = near.join(allowed, ["mask_id", "node_id"], "left_semi").join(marked, [*keys, "node_id"], "left_anti")
        state = cut(marked.union(scored(new).withColumn("hop", F.lit(None).cast("long"))))
    return _finish(marked, index, queries, pred, start, params)


def index_bytes(index: Index, pred: DataFrame) -> int:
    """What a broadcast of the index and the masks would weigh, about."""
    n, edges, width = index.adj.join(index.codes, "node_id").agg(F.count("*"), F.sum("degree"), F.max(F.size("code"))).first()
    return int((n or 0) * (24 + (width or 0) + pred.select("mask_id").distinct().count() / 4) + 8 * (edges or 0))


#: Masks whose flags are the bits of one long.
WORD = 60


def mask_bits(pred: DataFrame) -> tuple[list[str], DataFrame]:
    """The masks in order, and (node_id, w0, w1, ..): codes_ok of the first WORD
    masks as bits of w0, their adj_ok in w1, those of the next masks in w2, w3, .."""
    names = sorted(r[0] for r in pred.select("mask_id").distinct().collect())  # a row for each mask
    order = pred.sparkSession.createDataFrame([(m, i // WORD, 1 << i % WORD) for i, m in enumerate(names)], "mask_id string, word long, bit long")
    words = [(w, c) for w in range(-(-len(names) // WORD)) for c in ("codes_ok", "adj_ok")]
    bits = [F.coalesce(F.bit_or(F.when((F.col("word") == w) & F.col(c), F.col("bit"))), F.lit(0).cast("long")).alias(f"w{k}") for k, (w, c) in enumerate(words)]
    return names, pred.join(F.broadcast(order), "mask_id").groupBy("node_id").agg(*bits)


def search_arrow(index: Index, queries: DataFrame, pred: DataFrame, start: DataFrame, params: SearchParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same in memory; ValueError for an index over BROADCAST_BYTES.

    A node's record has its list and its code; nodes without either can't be
    entered. Neighbours are kept as places in the sorted ids, masks as bits of a
    node: what passes through the driver is a row for each node, in Arrow batches.
    """
    if index_bytes(index, pred) > BROADCAST_BYTES:
        raise ValueError("the index is too large to broadcast; use bsp")
    names, bits = mask_bits(pred)
    rows = index.adj.join(index.codes, "node_id").join(bits, "node_id", "left").na.fill(0, [c for c in bits.columns if c != "node_id"])
    rows = rows.select("node_id", F.slice("nbrs", F.lit(1), F.col("degree")).alias("nbrs"), F.col("code").cast("array<int>").alias("code"), *[c for c in bits.columns if c != "node_id"]).toArrow()
    rows = rows.sort_by("node_id").combine_chunks()
    column = lambda c: rows[c].combine_chunks()
    ids = column("node_id").to_numpy()
    lists = column("nbrs")
    ptr = np.concatenate([[0], lists.value_lengths().to_numpy().cumsum()]).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, lists.flatten().to_numpy()), max(len(ids) - 1, 0)).astype(np.int32)
    codes = column("code").flatten().to_numpy().reshape(len(ids), -1)
    codes = codes.astype(np.min_scalar_type(int(codes.max(initial=0))))
    words = [column(c).to_numpy() for c in bits.columns if c != "node_id"]
    del rows, lists
    shared = index.adj.sparkSession.sparkContext.broadcast((ids, ptr, at, codes, names, words))
    limit, centroids = params.io_limit if params.io_limit is not None else 1 << 60, index.centroids

    def beam(seed: int, table: np.ndarray, codes_ok: np.ndarray, adj_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, ptr, at, codes = shared.value[:4]
        first = np.arange(codes.shape[1]) * centroids  # of a chunk in a query's flat table
        dist = lambda p: table[codes[p] + first].cumsum(1)[:, -1]  # noqa: E731 - adds from left to right
        best = np.searchsorted(ids, [seed])
        near, seen = dist(best), np.zeros(len(ids), bool)
        seen[best] = True
        hop_of = np.zeros(len(ids), np.int32)
        found, far, sizes = [], [], []
        hop = done = 0
        while done < limit:
            front = np.flatnonzero(hop_of[best] == 0)[: params.W]
            if not len(front):
                break
            hop += 1
            go = best[front]
            hop_of[go] = hop
            found.append(go), far.append(near[front]), sizes.append(len(go))
            done += len(go)
            new = [at[ptr[p] : ptr[p + 1]] for p in go if adj_ok[p]]
            if not new:
                continue
            new = np.concatenate(new)
            new = np.unique(new[codes_ok[new] & ~seen[new]])
            if not len(new):
                continue
            seen[new] = True
            best, near = np.concatenate([best, new]), np.concatenate([near, dist(new)])
            order = np.lexsort((best, near))[: params.L]
            best, near = best[order], near[order]
        return ids[np.concatenate(found)], np.concatenate(far), np.repeat(np.arange(1, hop + 1), sizes)

    def run(batches):
        names, words = shared.value[4:]
        place, ok = {m: i for i, m in enumerate(names)}, {}
        for pdf in batches:
            for query, table, runs in zip(pdf["query_id"], pdf["adc"], pdf["runs"], strict=True):
                out = []
                for x in runs:  # mask_id, seed
                    if (m := x["mask_id"]) not in ok:
                        w, i = divmod(place[m], WORD)
                        ok[m] = tuple((words[2 * w + k] >> i & 1).astype(bool) for k in (0, 1))
                    out.append(beam(x["seed"], table, *ok[m]))
                p, d, h = map(np.concatenate, zip(*out, strict=True))
                masks = np.repeat(np.array([x["mask_id"] for x in runs], object), [len(x[0]) for x in out])
                yield pd.DataFrame({"mask_id": masks, "query_id": query, "node_id": p, "adc": d, "hop": h})

    parts = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jobs = start.where("seed IS NOT NULL").groupBy("query_id").agg(F.collect_list(F.struct("mask_id", "seed")).alias("runs"))  # a query's table goes once to all its masks
    jobs = jobs.join(index.tables, "query_id").select("query_id", "adc", "runs").repartition(parts, "query_id")
    state = jobs.mapInPandas(run, "mask_id string, query_id long, node_id long, adc double, hop long")
    return _finish(cut(state), index, queries, pred, start, params)


def masked_search(index: Index, queries: DataFrame, pred: DataFrame, start: DataFrame, params: SearchParams, strategy: str = "auto"):
    """(hits, stats, expanded); ``auto`` broadcasts an index that is small."""
    if strategy == "auto":
        strategy = "arrow" if index_bytes(index, pred) <= BROADCAST_BYTES else "bsp"
    if strategy not in ("arrow", "bsp"):
        raise ValueError(f"unknown strategy: {strategy}")
    return (search_arrow if strategy == "arrow" else search_bsp)(index, queries, pred, start, params)


def visit_counts(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """node_id, visits: queries that expanded the node; 0 where none did."""
    n = expanded.groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("visits"))
