"""The catalogue of queries, each (spark, sf_dir) -> DataFrame.

Fixture: rows of ``embeddings`` without a held-out sample are the nodes, the
sample (one row in 40, N_QUERIES at least) are the queries, the graph is the exact neighbour digraph, and codes come
from a sampled codebook. Ids and counts are long; doubles are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.functions import vectors as V
from tierscope.operators import corpus, curves, graph, masks, metrics, pq, recovery, search, sweep
from tierscope.operators.knn import exact_knn, self_test
from tierscope.plans.session import cut, global_rank, table

N_QUERIES, DIMS, K, DEGREE, SLOTS, GROUP = 50, 64, 10, 10, 16, 25
FRACTIONS = {"f00": 0.0, "f25": 0.25, "f50": 0.5, "f100": 1.0}
SEEDS = [101, 102, 103, 104, 105]
ORDERS, RANDOM = ["sequential", "in_degree", "hop_distance"], [f"random_{s}" for s in sweep.random_seeds(SEEDS)]
SEARCH = search.SearchParams(L=50, W=4, k=K)
#: For the search with a limit of expansions.
LIMITED = search.SearchParams(L=20, W=4, k=K, io_limit=9)
CURVE = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
BEAMS = [(20, 4), (50, 4), (50, 8)]
NAMED = {"hub": {"CODES": [0, 1, 2], "ADJ": [0, 1], "VEC": [0]}, "codes": {"CODES": [0, 3, 5]}, "mixed": {"CODES": [1, 2], "ADJ": [2, 4], "VEC": [1]}}


class Fixture:
    """The tables of one scale directory, built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        rows = table(self.spark, self.sf_dir, "embeddings")
        base, queries = corpus.held_out(rows, max(N_QUERIES, rows.count() // 40))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # one task has ranked a small table
        return cut(base.repartition(parts, "node_id")), cut(queries)

    @property
    def base(self) -> DataFrame:
        return self.split[0]

    @property
    def queries(self) -> DataFrame:
        return self.split[1]

    @property
    def nodes(self) -> DataFrame:
        return self.base.select("node_id")

    @cached_property
    def edges(self) -> DataFrame:
        return cut(graph.knn_graph(self.base, DEGREE))

    @cached_property
    def adj(self) -> DataFrame:
        return cut(graph.adjacency(self.edges))

    @cached_property
    def truth(self) -> DataFrame:
        return cut(exact_knn(self.base, self.queries, K))

    @cached_property
    def center(self) -> DataFrame:
        return pq.center(self.base, DIMS)

    @cached_property
    def book(self) -> DataFrame:
        return cut(pq.codebook(self.base, DIMS))

    @cached_property
    def code_lists(self) -> DataFrame:
        return cut(pq.encode_lists(self.base, self.book, DIMS))

    @property
    def codes(self) -> DataFrame:
        return pq.code_rows(self.code_lists)

    @cached_property
    def tables(self) -> DataFrame:
        return pq.adc_table(self.queries, self.book, self.center, DIMS)

    @cached_property
    def adc_hits(self) -> DataFrame:
        return pq.adc_scan(self.code_lists, self.tables, K)

    @cached_property
    def medoid(self) -> DataFrame:
        return cut(graph.medoid(self.base, DIMS))

    @cached_property
    def entries(self) -> DataFrame:
        return self.medoid.select(F.lit(0).cast("long").alias("ord"), "node_id", "vec")

    @cached_property
    def label_entries(self) -> DataFrame:
        return graph.medoid(self.base, DIMS, ("label",)).select(F.col("label").cast("long").alias("ord"), "node_id", "vec")

    @cached_property
    def hops(self) -> DataFrame:
        return cut(graph.hop_distance(self.nodes, self.edges, self.medoid.select("node_id")))

    @cached_property
    def in_degree(self) -> DataFrame:
        return graph.in_degree(self.nodes, self.edges)

    @cached_property
    def _groupings(self) -> dict[str, DataFrame]:
        return {}

    def order(self, name: str) -> DataFrame:
        if name == "sequential":
            return self.nodes.withColumn("rank", F.col("node_id"))
        if name == "in_degree":
            return masks.order_by_score(self.in_degree, "in_degree")
        if name == "hop_distance":
            return masks.order_by_score(self.hops, "hop", descending=False)
        if name == "tie_key":
            return masks.order_by_score(self.in_degree, "in_degree", tie=corpus.shuffled(99, "node_id")[0])
        return global_rank(self.nodes, corpus.shuffled(int(name.removeprefix("random_")), "node_id"), "rank")

    def grouping(self, name: str) -> DataFrame:
        if name not in self._groupings:
            self._groupings[name] = cut(masks.rank_grouping(cut(self.order(name)), GROUP))
        return self._groupings[name]

    @cached_property
    def n_groups(self) -> int:
        return -(-self.nodes.count() // GROUP)

    def mask_ids(self, ids) -> DataFrame:
        return self.spark.createDataFrame([(m,) for m in ids], "mask_id string")

    def pred(self, grouping: str, fractions: dict[str, float], tiers=masks.TIERS, prefix: str = "") -> DataFrame:
        named = {prefix + m: f for m, f in fractions.items()}
        rows = masks.masks_from_fractions(self.spark, self.n_groups, named, tiers)
        return masks.node_predicates(self.grouping(grouping), rows, self.mask_ids(named))

    def bytes(self, grouping: str, fractions: dict[str, float], prefix: str = "", convention: str = "actual") -> DataFrame:
        named = {prefix + m: f for m, f in fractions.items()}
        sizes = masks.group_bytes(self.grouping(grouping), self.adj, SLOTS, DIMS)
        return masks.mask_bytes(masks.masks_from_fractions(self.spark, self.n_groups, named), sizes, self.mask_ids(named), convention)

    @cached_property
    def index(self) -> search.Index:
        return search.Index(self.base, self.adj, self.code_lists, cut(pq.adc_arrays(self.tables)), DIMS)

    def search(self, pred: DataFrame, params: search.SearchParams = SEARCH, strategy: str = "auto", queries: DataFrame | None = None):
        queries = self.queries if queries is None else queries
        pred = cut(pred)
        start = search.seeds(search.entry_of(queries, self.entries, DIMS), pred, self.hops)
        return search.masked_search(self.index, queries, pred, cut(start), params, strategy)

    def records(self, pred: DataFrame, params: search.SearchParams = SEARCH) -> DataFrame:
        hits, stats, _ = self.search(pred, params)
        recall = metrics.recall_at_k(hits, self.truth, stats.select("mask_id", "query_id"))
        return metrics.run_records(recall, metrics.absence_ceiling(self.truth, pred), stats)

    # sweeps -----------------------------------------------------------------------

    def sweep_groupings(self, orders: list[str]) -> DataFrame:
        """(order, node_id, group_id) of several orders: one ranking of them all, as
        each has every node."""
        rows, keys = self.nodes, []
        if "in_degree" in orders:
            rows = rows.join(self.in_degree, "node_id")
        if "hop_distance" in orders:
            rows = rows.join(self.hops, "node_id")
        for i, o in enumerate(orders):
            score = {"in_degree": -F.col("in_degree"), "hop_distance": F.col("hop")} if not o.startswith("random_") else {}
            text = corpus.shuffled(int(o.removeprefix("random_")), "node_id")[0] if o.startswith("random_") else F.lit("")
            keys.append(F.struct(F.lit(i).alias("i"), F.lit(o).alias("order"), score.get(o, F.lit(0)).cast("long").alias("s"), text.alias("h")))
        rows = rows.select("node_id", F.explode(F.array(*keys)).alias("k")).select("node_id", "k.*")
        ranked = global_rank(rows, [F.col("i"), F.col("s"), F.col("h"), F.col("node_id")])
        group = F.floor((F.col("rank") - F.col("i") * self.nodes.count()) / GROUP).cast("long")
        return cut(ranked.select("order", "node_id", group.alias("group_id")))

    def sweep_limits(self, orders: list[str]) -> DataFrame:
        """(order, mask_id, n_groups) of all fractions."""
        counts = {m: masks.groups_of_fraction(self.n_groups, f) for m, f in CURVE.items()}
        return self.spark.createDataFrame([(o, f"{o}|{m}", n) for o in orders for m, n in counts.items()], "order string, mask_id string, n_groups long")

    def ceiling_points(self, orders: list[str]) -> DataFrame:
        """order, mask_id, n_groups, bytes_total, mean_ceiling: true neighbours and
        masks give it, without a search."""
        groupings, limits = self.sweep_groupings(orders), self.sweep_limits(orders)
        near = groupings.join(self.truth.select("node_id").distinct(), "node_id", "left_semi")
        ceilings = metrics.absence_ceiling(self.truth, masks.prefix_predicates(near, limits)).groupBy("mask_id").agg(F.avg("ceiling").alias("mean_ceiling"))
        return cut(masks.prefix_bytes(groupings, limits, self.adj, DIMS).join(ceilings, "mask_id"))

    def sweep_points(self, orders: list[str]) -> DataFrame:
        """order, mask_id, n_groups, bytes_total, mean_recall, mean_ceiling, all in one
        search. Masks of no group or of all are the same in every order, and run once."""
        groupings, limits = self.sweep_groupings(orders), self.sweep_limits(orders)
        run_as = {f"{o}|{m}": f"{o if 0 < f < 1 else orders[0]}|{m}" for o in orders for m, f in CURVE.items()}
        run_as = self.spark.createDataFrame(list(run_as.items()), "mask_id string, run_as string")
        runs = limits.join(F.broadcast(run_as.where("mask_id = run_as")), "mask_id").drop("run_as")
        records = self.records(masks.prefix_predicates(groupings, runs)).select(F.col("mask_id").alias("run_as"), "mean_recall", "mean_ceiling")
        records = run_as.join(cut(records), "run_as").drop("run_as")
        return cut(masks.prefix_bytes(groupings, limits, self.adj, DIMS).join(records, "mask_id"))

    @cached_property
    def curve(self) -> DataFrame:
        """order, bytes_total, mean_recall, mean_ceiling, random orders averaged."""
        points = self.sweep_points(ORDERS + RANDOM)
        random = curves.random_average(points.where(F.col("order").startswith("random_")))
        ceilings = points.where(F.col("order").startswith("random_")).groupBy("n_groups").agg(F.avg("mean_ceiling").alias("mean_ceiling"))
        random = random.join(ceilings, "n_groups").select(F.lit("random_avg").alias("order"), "bytes_total", "mean_recall", "mean_ceiling")
        return points.where(~F.col("order").startswith("random_")).select("order", "bytes_total", "mean_recall", "mean_ceiling").unionByName(random)

    @cached_property
    def normalized(self) -> DataFrame:
        return cut(curves.normalized(self.curve, curves.intact_recall(self.curve)))

    # stand-ins from other tables -----------------------------------------------------

    @property
    def log(self) -> DataFrame:
        """events as a query log: latency and a recall between 0 and 1."""
        e = table(self.spark, self.sf_dir, "events")
        return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency"), ((F.col("event_id") % 11) / 10).cast("double").alias("recall"))

    @property
    def windows(self) -> DataFrame:
        w = recovery.windowed_quality(self.log, "1 hour", 1.02)
        return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))

    @property
    def units(self) -> DataFrame:
        """Restore units: each group's tiers, with in-degree as the gain."""
        gains = self.grouping("sequential").join(self.in_degree, "node_id").groupBy("group_id").agg(F.sum("in_degree").cast("double").alias("g"))
        sizes = masks.group_bytes(self.grouping("sequential"), self.adj, SLOTS, DIMS).join(gains, "group_id")
        rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(b).alias("bytes"), (F.col("g") * w).alias("gain")) for t, b, w in (("CODES", "codes_bytes", 1.0), ("ADJ", "adj_bytes_actual", 4.0), ("VEC", "vec_bytes", 2.0))]))
        return sizes.select("group_id", rows.alias("u")).select("group_id", "u.*")

    @property
    def mutation_log(self) -> DataFrame:
        """Two or three whole-list records for each node, made from the graph."""
        versions = F.explode(F.sequence(F.lit(0), (F.col("node_id") % 3).cast("int")))
        rows = self.adj.select("node_id", "nbrs", versions.alias("v"))
        nbrs = F.slice("nbrs", 1, F.col("v") + 3)
        return rows.select((F.col("v") * 100000 + F.col("node_id")).cast("long").alias("lsn"), "node_id", F.size(nbrs).alias("degree"), nbrs.alias("nbrs"))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to 6 digits, ints as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        out.append((F.round(c, 6) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c).alias(f.name))
    df = df.select(*out)
    return df.select(*columns) if columns else df


def _list(c: str):
    return F.array_join(c, ",").alias(c)


Q: dict[str, Callable[[Fixture], DataFrame]] = {
    "heldout_split": lambda f: f.base.select("vec_id", F.lit(False).alias("is_query"), F.col("node_id").alias("new_id")).union(f.queries.select("vec_id", F.lit(True), "query_id")),
    "workload_eval_split": lambda f: corpus.split_workload(f.queries),
    "l2_entry_distance": lambda f: search.entry_of(f.queries, f.label_entries, DIMS),
    "exact_knn_top10": lambda f: exact_knn(f.base, f.queries, K),
    "exact_knn_unrolled": lambda f: exact_knn(f.base, f.queries, K, "unrolled", DIMS),
    "exact_knn_expanded_form": lambda f: _expanded(f).select("query_id", "rank", "node_id"),
    "knn_selftest_agreement": lambda f: self_test(exact_knn(f.base, f.queries, K), _expanded(f)).withColumn("max_diff", F.round("max_diff", 4)),
    "knn_graph_edges": lambda f: f.edges,
    "medoid": lambda f: f.medoid.select("node_id", "dist"),
    "entry_points_by_label": lambda f: f.label_entries.select("ord", "node_id"),
    "degrees": lambda f: f.adj.select("node_id", "degree"),
    "neighbors_of_ids": lambda f: graph.neighbors_of(f.adj, f.truth.select("node_id").distinct()),
    "point_lookup_vectors": lambda f: f.base.join(f.truth.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.round(F.element_at("vec", 1), 6).alias("x0"), F.round(F.element_at("vec", 64), 6).alias("x63")),
    "pq_codes": lambda f: f.codes,
    "pq_decode_error": lambda f: pq.decode(f.codes, f.book, f.center).join(f.base, "node_id").select("node_id", V.relative_error(F.col("decoded"), F.col("vec")).alias("rel_err")),
    "adc_table": lambda f: f.tables,
    "adc_scan_top10": lambda f: f.adc_hits.select("query_id", "rank", "node_id", "dist"),
    "adc_exact_rank_overlap": lambda f: _ids(f.truth, "t").join(_ids(f.adc_hits, "a"), "query_id").select("query_id", V.overlap(F.col("t"), F.col("a")).alias("overlap")),
    "in_degree": lambda f: f.in_degree,
    "hop_distance": lambda f: f.hops,
    "hop_distance_multi": lambda f: graph.hop_distance(f.nodes, f.edges, f.label_entries.select("node_id")),
    "order_sequential": lambda f: f.order("sequential"),
    "order_in_degree": lambda f: f.order("in_degree"),
    "order_in_degree_tie_key": lambda f: f.order("tie_key"),
    "order_hop": lambda f: f.order("hop_distance"),
    "order_random": lambda f: f.order("random_101"),
    "rank_grouping": lambda f: f.grouping("in_degree"),
    "group_byte_stats": lambda f: masks.group_bytes(f.grouping("in_degree"), f.adj, SLOTS, DIMS),
    "mask_fraction_nodes": lambda f: f.pred("in_degree", FRACTIONS, ("CODES", "ADJ")),
    "mask_named_groups": lambda f: masks.node_predicates(f.grouping("sequential"), masks.masks_from_groups(f.spark, NAMED), f.mask_ids(NAMED)),
    "mask_bytes_sweep": lambda f: f.bytes("in_degree", FRACTIONS),
    "mask_bytes_reserved": lambda f: f.bytes("in_degree", FRACTIONS, convention="reserved"),
    "mask_cumulative_check": lambda f: masks.not_cumulative(masks.masks_from_fractions(f.spark, f.n_groups, FRACTIONS), "f25", "f50").agg(F.count("*").alias("violations")),
    "absence_ceiling_per_query": lambda f: metrics.absence_ceiling(f.truth, f.pred("sequential", FRACTIONS)),
    "absence_ceiling_curve": lambda f: metrics.absence_ceiling(f.truth, f.pred("sequential", CURVE)).groupBy("mask_id").agg(F.avg("ceiling").alias("mean_ceiling")),
    "fallback_seed_per_mask": lambda f: search.fallback_seeds(f.pred("random_101", FRACTIONS), f.hops),
    "masked_search_iolimited": lambda f: f.search(f.pred("random_101", FRACTIONS), LIMITED)[0],
    "masked_search_stats": lambda f: f.search(f.pred("random_101", FRACTIONS))[1],
    "masked_search_expanded": lambda f: f.search(f.pred("random_101", FRACTIONS))[2],
    "masked_search_bsp": lambda f: f.search(f.pred("random_101", FRACTIONS), strategy="bsp")[0],
    "masked_search_full": lambda f: f.search(f.pred("random_101", FRACTIONS))[0],
    "masked_search_throughput": lambda f: _all_nodes(f),
    "traversal_frequency": lambda f: search.visit_counts(f.nodes, f.search(f.pred("sequential", {"all": 1.0}))[2]),
    "never_visited_fraction": lambda f: search.visit_counts(f.nodes, f.search(f.pred("sequential", {"all": 1.0}))[2]).agg(F.avg((F.col("visits") == 0).cast("int")).alias("never_visited")),
    "recall_at_10_adc_scan": lambda f: metrics.recall_at_k(f.adc_hits.withColumn("mask_id", F.lit("adc")), f.truth, f.queries.select("query_id", F.lit("adc").alias("mask_id"))),
    "adc_exact_agreement": lambda f: metrics.agreement(f.adc_hits, f.truth, f.truth),
    "run_records": lambda f: f.records(f.pred("random_101", FRACTIONS)).drop("per_query"),
    "tier_contributions": lambda f: curves.tier_contributions(f.records(_tiers(f))),
    "beam_sweep_broken_nav": lambda f: reduce(DataFrame.unionByName, [curves.broken_navigation(f.records(f.pred("random_101", {"f50": 0.5}), search.SearchParams(b, w, K))).select(F.lit(b).alias("L"), F.lit(w).alias("W"), "mean_recall", "mean_ceiling", "broken_navigation", "mean_hops") for b, w in BEAMS]),
    "ceiling_curve": lambda f: f.ceiling_points(ORDERS).select("order", "bytes_total", "mean_ceiling"),
    "random_avg_ceiling_curve": lambda f: f.ceiling_points(RANDOM).groupBy("n_groups").agg(F.avg("bytes_total").alias("bytes_total"), F.avg("mean_ceiling").alias("mean_ceiling")).drop("n_groups"),
    "restoration_curve": lambda f: f.sweep_points(ORDERS).select("order", "bytes_total", "mean_recall"),
    "random_avg_curve": lambda f: curves.random_average(f.sweep_points(RANDOM)),
    "normalized_curve": lambda f: f.normalized.select("order", "bytes_total", "mean_recall", "normalized_recall"),
    "crossing_bytes": lambda f: curves.crossings(f.normalized),
    "h1_ratio": lambda f: curves.h1_ratio(curves.crossings(f.normalized)),
    "sweep_cache_antijoin": lambda f: sweep.missing_runs(f.nodes.select(F.md5(F.col("node_id").cast("string")).alias("run_id"), "node_id"), f.nodes.where("node_id % 3 = 0").select(F.md5(F.col("node_id").cast("string")).alias("run_id"))),
    "windowed_p99_recall": lambda f: f.windows,
    "ttrs": lambda f: recovery.ttrs(f.windows, F.col("recall") >= 0.2),
    "recall_deficit_integral": lambda f: recovery.recall_deficit(f.windows, 0.5, 3600.0),
    "planner_greedy_order": lambda f: recovery.greedy_plan(f.units, 1e6),
    "neighbor_closure": lambda f: graph.neighbor_closure(f.grouping("sequential"), f.edges),
    "gain_deciles": lambda f: recovery.gain_deciles(f.units),
    "mutation_replay": lambda f: recovery.replay(f.mutation_log).select("node_id", "degree", _list("nbrs"), "lsn"),
    "mutation_replay_watermark": lambda f: recovery.replay(f.mutation_log, 150_000).select("node_id", "degree", "lsn"),
    "miss_policy": lambda f: recovery.miss_policy(f.log.select("event_id", (F.col("latency") / 100).alias("eta"), F.col("recall").alias("left"), (F.col("event_id") % 4).alias("gain"))).select("event_id", "action"),
    "ewma_latency": lambda f: _ewma(f),
    "checkpoint_manifest": lambda f: recovery.manifest(f.units.select("tier", "group_id", F.explode(F.sequence(F.lit(1), (F.col("group_id") % 3 + 1).cast("int"))).alias("epoch")).withColumn("path", F.concat_ws("/", "tier", "group_id", "epoch"))),
    "simulate_policies": lambda f: _simulate(f),
    "h2_ratio": lambda f: recovery.h2_ratio(_simulate(f).where("recall >= 0.5").groupBy("policy").agg(F.min("t").alias("ttrs")), "greedy"),
    "estimator_calibration": lambda f: recovery.calibration(_ids(f.truth, "t").join(_ids(f.adc_hits, "a"), "query_id").select("query_id", (F.col("query_id") / 50).alias("predicted"), V.recall(F.col("a"), F.col("t")).alias("actual")), 5),
}


def _expanded(f: Fixture) -> DataFrame:
    from tierscope.operators.knn import knn_sql

    return knn_sql(f.base, f.queries, K, expanded=True).select("query_id", "node_id", "dist", "rank")


def _ids(d: DataFrame, name: str) -> DataFrame:
    return d.groupBy("query_id").agg(F.collect_set("node_id").alias(name))


def _all_nodes(f: Fixture) -> DataFrame:
    """Every node as a query, nothing masked, a wide beam."""
    queries = f.base.select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    tables = cut(pq.adc_arrays(pq.adc_table(queries, f.book, f.center, DIMS)))
    index = search.Index(f.base, f.adj, f.code_lists, tables, DIMS)
    pred = cut(f.pred("sequential", {"all": 1.0}))
    start = cut(search.seeds(search.entry_of(queries, f.entries, DIMS), pred, f.hops))
    return search.masked_search(index, queries, pred, start, search.SearchParams(50, 4, K))[0]


def _tiers(f: Fixture) -> DataFrame:
    parts = [f.pred("sequential", {m: 1.0}, t) for m, t in (("codes", ("CODES",)), ("codes_adj", ("CODES", "ADJ")), ("full", masks.TIERS))]
    return reduce(DataFrame.unionByName, parts)


def _ewma(f: Fixture) -> DataFrame:
    from tierscope.streaming.quality import smoothed_batch

    return smoothed_batch(f.log.select(F.concat(F.lit("t"), F.col("event_id") % 3).alias("tier"), F.concat(F.lit("s"), F.col("event_id") % 2).alias("source"), F.col("event_id").alias("ts"), "latency"))


def _simulate(f: Fixture) -> DataFrame:
    """Three restore policies over the group tiers: by density, by group, by tier."""
    greedy = recovery.greedy_plan(f.units, 1e4).select(F.lit("greedy").alias("policy"), "at", "bytes")
    from pyspark.sql.window import Window as W

    def fixed(name: str, *order) -> DataFrame:
        so_far = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return f.units.select(F.lit(name).alias("policy"), (F.sum("bytes").over(so_far) / 1e4).alias("at"), "bytes")

    plan = greedy.union(fixed("B3", "group_id", "tier")).union(fixed("B4", "tier", "group_id"))
    total = f.units.agg(F.sum("bytes").alias("b"))
    curve = total.select(F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"), "b").select((F.col("i") * F.col("b") / 10).alias("bytes_total"), (F.col("i") / 10).alias("recall"))
    ticks = f.spark.createDataFrame([(p, float(t)) for p in ("greedy", "B3", "B4") for t in range(0, 30)], "policy string, t double")
    return recovery.simulate(plan, curve, ticks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tierscope.plans import more

    every = Q | more.Q

    def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: _r(every[name](Fixture(spark, sf_dir)))

    return {name: run(name) for name in every}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each query's true neighbours that sequential restoration has
    reached, at a few fractions."""
    f = Fixture(spark, sf_dir)
    fractions = f.spark.createDataFrame([(m, x) for m, x in FRACTIONS.items()], "mask_id string, fraction double")
    ceiling = metrics.absence_ceiling(f.truth, f.pred("sequential", FRACTIONS))
    return ceiling.join(F.broadcast(fractions), "mask_id").select("query_id", "fraction", F.round("ceiling", 6).alias("absence_ceiling"))
