"""Independent answers: plain versions of searches, graphs, codebooks, plans."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscope.operators import checkpoints, graph, knn, masks, metrics, policies, pq, recovery, search
from tierscope.plans import more
from tierscope.plans.catalog import DIMS, FRACTIONS, K, Fixture, _all_nodes
from tierscope.plans.session import global_totals, shared_dir
from tierscope.streaming import quality


@pytest.fixture(scope="module")
def f(spark, sf):
    return Fixture(spark, sf)


@pytest.fixture(scope="module")
def plain(f):
    """The fixture's tables as plain Python values."""
    vec = {r["node_id"]: np.array(r["vec"]) for r in f.base.collect()}
    nbrs = {r["node_id"]: list(r["nbrs"])[: r["degree"]] for r in f.adj.collect()}
    codes = {r["node_id"]: list(r["code"]) for r in pq.code_arrays(f.codes).collect()}
    return vec, nbrs, codes, {r["query_id"]: np.array(r["qvec"]) for r in f.queries.collect()}


def beam_search(seed, adc, nbrs, codes_ok, adj_ok, params):
    """One query, one heap of candidates: (expanded nodes in order, with hops)."""
    seen, worst_first, expanded, hop = {seed}, [], {}, 0
    heapq.heappush(worst_first, (-adc(seed), -seed))
    while params.io_limit is None or len(expanded) < params.io_limit:
        todo = sorted((-d, -n) for d, n in worst_first if -n not in expanded)[: params.W]
        if not todo:
            break
        hop += 1
        found = []
        for _, n in todo:
            expanded[n] = hop
            found += nbrs[n] if adj_ok(n) else []
        for n in found:
            if n not in seen and codes_ok(n):
                seen.add(n)
                heapq.heappush(worst_first, (-adc(n), -n))
        while len(worst_first) > params.L:
            heapq.heappop(worst_first)
    return expanded


def plain_search(f, plain, queries, pred, params):
    """{(mask, query): (hits, hops, expanded, misses, code only)} by loops."""
    vec, nbrs, codes, _ = plain
    flags = {(r["mask_id"], r["node_id"]): (r["codes_ok"], r["adj_ok"], r["vec_ok"]) for r in pred.collect()}
    hops = {r["node_id"]: r["hop"] for r in f.hops.collect()}
    entry, book = f.medoid.first()["node_id"], {(r["chunk"], r["centroid"]): np.array(r["sub"]) for r in f.book.collect()}
    center, out = np.array(f.center.first()["center"]), {}
    step = DIMS // pq.CHUNKS
    for mask in sorted({m for m, _ in flags}):
        there = [n for n in vec if flags[mask, n][0]]
        seed = entry if flags[mask, entry][0] else min(there, key=lambda n: (hops[n], n), default=None)
        for q, x in queries.items():
            parts = (x - center).reshape(pq.CHUNKS, step)
            table = {k: float(((parts[k[0]] - s) ** 2).sum()) for k, s in book.items()}
            adc = lambda n: float(np.cumsum([table[c, code] for c, code in enumerate(codes[n])])[-1])  # noqa: B023, E731
            expanded = {} if seed is None else beam_search(seed, adc, nbrs, lambda n: flags[mask, n][0], lambda n: flags[mask, n][1], params)  # noqa: B023
            scored = sorted((float(((vec[n] - x) ** 2).sum()) if flags[mask, n][2] else adc(n), n) for n in expanded)[: params.k]
            out[mask, q] = [n for _, n in scored], max(expanded.values(), default=0), len(expanded), sum(not flags[mask, n][1] for n in expanded), sum(not flags[mask, n][2] for n in expanded)
    return out


@pytest.mark.parametrize("strategy", ["arrow", "bsp"])
@pytest.mark.parametrize("params", [search.SearchParams(50, 4, K), search.SearchParams(12, 3, K, 17)])
def test_masked_search_equals_a_heap(f, plain, params, strategy):
    """200 pairs of masks and queries against a sequential search."""
    pred = f.pred("random_101", FRACTIONS)
    want = plain_search(f, plain, plain[3], pred, params)
    hits, stats, _ = f.search(pred, params, strategy)
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault((r["mask_id"], r["query_id"]), []).append(r["node_id"])
    assert len(want) == 4 * f.queries.count()
    assert got == {k: v[0] for k, v in want.items() if v[0]}
    assert {(r["mask_id"], r["query_id"]): (r["hops"], r["num_expanded"], r["miss_count"], r["code_only_count"]) for r in stats.collect()} == {k: v[1:] for k, v in want.items()}


def test_throughput_search_equals_a_heap(f, plain):
    """Every node as a query, nothing masked; a plain search of every ninth."""
    vec = plain[0]
    some = {n: v for n, v in vec.items() if n % 9 == 0}
    want = plain_search(f, plain, some, f.pred("sequential", {"all": 1.0}), search.SearchParams(50, 4, K))
    got = {}
    for r in _all_nodes(f).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert len(got) == len(vec) and {n: got[n] for n in some} == {q: v[0] for (_, q), v in want.items()}


def test_smoothed_latencies_equal_a_loop(f):
    rows = f.log.select(F.concat(F.lit("t"), F.col("event_id") % 3).alias("tier"), F.concat(F.lit("s"), F.col("event_id") % 2).alias("source"), F.col("event_id").alias("ts"), "latency")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["ts"]):
        k = r["tier"], r["source"]
        want[k] = 0.2 * r["latency"] + 0.8 * want[k] if k in want else r["latency"]
    assert {(r["tier"], r["source"]): r["ewma"] for r in quality.smoothed_batch(rows).collect()} == pytest.approx(want)


def test_many_queries_go_by_pairs_of_blocks(f, spark):
    queries = f.base.select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    one = {(r["query_id"], r["rank"]): r["node_id"] for r in knn.knn_blocked(f.base, queries, 5).collect()}
    several = {(r["query_id"], r["rank"]): r["node_id"] for r in knn.knn_blocked(f.base, queries, 5, block=70, base_block=130).collect()}
    assert one == several and len(one) == 5 * f.base.count()
    with pytest.raises(ValueError):
        knn.knn_sql(f.base, spark.range(knn.QUERY_BLOCK + 1).withColumnRenamed("id", "query_id"), 5)


def test_robust_prune_equals_loops(f, plain):
    vec, nbrs, _, _ = plain
    alpha, degree = 1.2, 6
    candidates = f.edges.select("src", "dst")
    got = {}
    for r in graph.robust_prune(f.base, candidates, degree, alpha).orderBy("pos").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    dist = lambda a, b: float(((vec[a] - vec[b]) ** 2).sum())
    for src, near in nbrs.items():
        left, taken = sorted(near, key=lambda n: (dist(src, n), n)), []
        while left and len(taken) < degree:
            best = left.pop(0)
            taken.append(best)
            left = [n for n in left if alpha * alpha * dist(best, n) > dist(src, n)]
        assert got[src] == taken


def test_pruned_graph_is_navigable(f):
    edges = graph.pruned_graph(f.base, f.edges, 10)
    worst = edges.groupBy("src").count().agg(F.max("count"), F.count("*")).first()
    assert worst[0] <= 10 and worst[1] == f.base.count()
    reach = lambda e: graph.hop_distance(f.nodes, e, f.medoid.select("node_id")).join(f.nodes, "node_id").agg(F.max("hop")).first()[0]
    assert reach(edges) >= 1


def test_training_lowers_the_error_and_equals_numpy(f):
    base = np.array([r["vec"] for r in f.base.orderBy("node_id").collect()])
    book = pq.trained(f.base, DIMS, centroids=16, rounds=3)
    rows = {(r["chunk"], r["centroid"]): r["sub"] for r in book.collect()}
    start = {(r["chunk"], r["centroid"]): r["sub"] for r in pq.codebook(f.base, DIMS).collect()}
    center = np.array(f.center.first()["center"])
    step = DIMS // pq.CHUNKS
    for c in (0, 7, 31):
        v = (base - center)[:, c * step : (c + 1) * step]
        b = np.array([start[c, j] for j in range(16)])
        for _ in range(3):
            near = ((v[:, None] - b[None]) ** 2).sum(2).argmin(1)
            b = np.array([np.round(v[near == j].mean(0), 6) if (near == j).any() else b[j] for j in range(16)])
        assert np.allclose(b, [rows[c, j] for j in range(16)], atol=2e-6)
    error = lambda k: pq.decode(pq.encode(f.base, k, DIMS), k, f.center).join(f.base, "node_id").select(F.avg(F.aggregate(F.zip_with("decoded", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))).first()[0]
    assert error(book) < 0.95 * error(pq.codebook(f.base, DIMS))


def test_running_totals_by_ranges_equal_one_task(spark):
    rows = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(101)).cast("double").alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    a, b = ({r["id"]: (r["rank"], r["t"]) for r in global_totals(rows, order, {"t": F.col("v")}, small=n).collect()} for n in (100, 10_000))
    assert a == b and max(t for _, t in a.values()) == rows.agg(F.sum("v")).first()[0]


def test_buckets_equal_ntile(spark):
    from pyspark.sql.window import Window as W

    for n in (3, 10, 57):
        rows = spark.range(n)
        want = {r["id"]: r["b"] for r in rows.withColumn("b", F.ntile(10).over(W.orderBy("id"))).collect()}
        assert {r["id"]: r["b"] for r in recovery.buckets(rows, [F.col("id")], 10, "b").collect()} == want


# policies -------------------------------------------------------------------------


def units(spark):
    rows = [(g, t, b, float(gain), v, a) for g, (gain, v, a) in enumerate([(5, 3, 7), (50, 1, None), (20, 9, 1)]) for t, b in (("CODES", 10.0), ("ADJ", 30.0), ("VEC", 60.0))]
    return spark.createDataFrame(rows, "group_id long, tier string, bytes double, gain double, visits long, asked long")


@pytest.mark.parametrize(("policy", "groups", "times"), [("B3", [2, 0, 1], [10, 20, 30]), ("B4", [2, 0, 1], [10, 20, 30]), ("A2", [1, 2, 0], None), ("B5", [0, 1, 2], None)])
def test_orders_of_policies(spark, policy, groups, times):
    rows = policies.restore_plan(units(spark), policy, 10.0).orderBy("pos").collect()
    assert [r["group_id"] for r in rows][::3] == groups and [r["tier"] for r in rows[:3]] == ["CODES", "ADJ", "VEC"]
    if times:  # whole records
        assert [r["at"] for r in rows][::3] == times and [r["at"] for r in rows][2::3] == times


def test_all_at_once_policies(spark):
    at = lambda p: {r["at"] for r in policies.restore_plan(units(spark), p, 10.0, replay_seconds=2.0, build_seconds=99.0).collect()}
    assert at("B0") == {32.0} and at("B1") == {99.0} and at("B2") == {30.0}
    with pytest.raises(ValueError):
        policies.restore_plan(units(spark), "B9", 1.0)
    with pytest.raises(ValueError):
        policies.ordered(units(spark), "guess")


def test_latency_of_misses_and_beams(spark):
    reached = spark.createDataFrame([(p, float(t), 25.0 * t) for p in ("A4_skip", "A4_fetch", "greedy", "A7") for t in range(5)], "policy string, t double, bytes double")
    got = {(r["policy"], r["t"]): r["p99"] for r in policies.latency(reached, policies.switches(spark), 100.0, 0.1, 0.4).collect()}
    assert [got["A4_skip", t] for t in range(5)] == [0.1] * 5
    assert [got["A4_fetch", t] for t in range(5)] == pytest.approx([0.5, 0.4, 0.3, 0.2, 0.1])
    assert [got["greedy", t] for t in range(5)] == pytest.approx([0.1, 0.1, 0.3, 0.2, 0.1])
    assert [got["A7", t] for t in range(5)] == pytest.approx([0.2, 0.2, 0.4, 0.3, 0.2])


def test_evaluation_greedy_equals_loops(f):
    """Against measuring one mask at a time."""
    grouping = more._coarse(f)
    got = [(r["group_id"], r["recall"]) for r in more._greedy_order(f).orderBy("step").collect()]
    taken = []
    for step in range(1):  # the first step; a search for each candidate
        best = None
        for g in [x for x in range(more.COARSE) if x not in taken]:
            rows = masks.masks_from_groups(f.spark, {"m": {t: [*taken, g] for t in masks.TIERS}})
            pred = masks.node_predicates(grouping, rows, f.mask_ids(["m"]))
            hits, stats, _ = f.search(pred, search.SearchParams(20, 4, K))
            recall = metrics.recall_at_k(hits, f.truth, stats.select("mask_id", "query_id")).agg(F.avg("recall")).first()[0]
            if best is None or recall > best[1] + 1e-12:
                best = g, recall
        assert got[step] == (best[0], pytest.approx(best[1]))
        taken.append(best[0])
    assert sorted(g for g, _ in got) == list(range(more.COARSE))


# checkpoints, streams ------------------------------------------------------------------


def test_only_changed_groups_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    make = lambda later: spark.createDataFrame([(t, g, n, f"{n}{later if g == 1 and t == 'ADJ' else ''}") for t in ("ADJ", "VEC") for g in range(3) for n in range(g * 4, g * 4 + 4)], "tier string, group_id long, node_id long, payload string")
    first = checkpoints.write_checkpoint(make(""), path, 1)
    assert first.count() == 6 and checkpoints.write_checkpoint(make(""), path, 2).count() == 0
    again = checkpoints.write_checkpoint(make("x"), path, 3)
    assert [(r["tier"], r["group_id"], r["epoch"]) for r in again.collect()] == [("ADJ", 1, 3)]
    assert checkpoints.write_checkpoint(make("x"), path, 3).count() == 1  # the same epoch again
    rows = {(r["tier"], r["node_id"]): (r["payload"], r["epoch"]) for r in checkpoints.read_checkpoint(spark, path).collect()}
    assert len(rows) == 24 and rows["ADJ", 5] == ("5x", 3) and rows["VEC", 5] == ("5", 1)
    old = {(r["tier"], r["node_id"]): r["payload"] for r in checkpoints.read_checkpoint(spark, path, 2).collect()}
    assert old["ADJ", 5] == "5" and len(old) == 24
    assert checkpoints.read_checkpoint(spark, f"file://{tmp_path}/none").count() == 0


def test_arrivals_are_poisson_and_repeat(spark):
    a = np.array([r["at"] for r in quality.arrivals_batch(4000, 50.0, spark).orderBy("query_id").collect()])
    gaps = np.diff(np.r_[0, a])
    assert (gaps > 0).all() and gaps.mean() == pytest.approx(1 / 50, rel=0.1)
    # exponential: mean equals deviation, and the share over the mean is 1/e
    assert gaps.std() == pytest.approx(gaps.mean(), rel=0.1) and (gaps > gaps.mean()).mean() == pytest.approx(math.exp(-1), abs=0.04)
    assert (a == [r["at"] for r in quality.arrivals_batch(4000, 50.0, spark).orderBy("query_id").collect()]).all()


def test_live_arrivals(spark, tmp_path):
    import time

    q = quality.arrivals(spark, 50).writeStream.format("memory").queryName("live").option("checkpointLocation", f"file://{tmp_path}/live").start()
    try:
        began = time.time()
        while time.time() - began < 40 and spark.table("live").count() < 50:
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.table("live").collect()
    assert len(rows) >= 50 and len({r["query_id"] for r in rows}) == len(rows) and all(r["ts"] is not None for r in rows)


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    assert shared_dir(spark)

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
