import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscope.functions import vectors as V
from tierscope.operators import corpus, curves, graph, masks, metrics, recovery, search, sweep
from tierscope.operators.knn import exact_knn, self_test
from tierscope.plans.catalog import DIMS, K, Fixture
from tierscope.plans.session import global_rank


@pytest.fixture(scope="module")
def f(spark, sf):
    return Fixture(spark, sf)


def edges(spark, pairs):
    return spark.createDataFrame([(a, i, b) for i, (a, b) in enumerate(pairs)], "src long, pos long, dst long")


def ids(spark, xs, name="node_id"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} long")


# vectors ------------------------------------------------------------------------


def test_distances_and_set_functions(spark):
    row = spark.range(1).select(
        V.l2_sq(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))),
        V.l2_sq(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0)), 2),
        V.l2_expanded(F.array(F.lit(1.0)), F.array(F.lit(1.0))),
        V.recall(F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))),
        V.same_set(F.array(F.lit(2), F.lit(1)), F.array(F.lit(1), F.lit(2))),
        V.adc(F.array(F.lit(1), F.lit(0)), F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]), 2),
    ).first()
    assert tuple(row) == (25.0, 25.0, 0.0, pytest.approx(2 / 3), True, 5.0)


def test_strategies_of_exact_neighbours_agree(f):
    got = [exact_knn(f.base, f.queries, K, s, DIMS) for s in ("blocked", "unrolled", "sql")]
    a = {(r[0], r[3]): r[1] for r in got[0].collect()}
    assert len(a) == f.queries.count() * K
    for other in got[1:]:
        assert {(r[0], r[3]): r[1] for r in other.collect()} == a
    blocks = __import__("tierscope.operators.knn", fromlist=["x"]).knn_blocked(f.base, f.queries, K, block=7)
    assert {(r["query_id"], r["rank"]): r["node_id"] for r in blocks.collect()} == a
    assert tuple(self_test(got[0], blocks).first())[:2] == (0, f.queries.count())
    with pytest.raises(ValueError):
        exact_knn(f.base, f.queries, K, "guess")


def test_global_rank_by_ranges_equals_one_task(spark):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("s"))
    order = [F.col("s").desc(), F.col("id")]
    a = {r["id"]: r["rank"] for r in global_rank(rows, order, small=100).collect()}
    assert a == {r["id"]: r["rank"] for r in global_rank(rows, order).collect()} and sorted(a.values()) == list(range(5000))


# graph ------------------------------------------------------------------------------


def test_in_degree_and_hops_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (120, 2)) if a != b]
    nodes, e = ids(spark, range(60)), edges(spark, pairs)
    assert {r[0]: r[1] for r in graph.in_degree(nodes, e).collect()} == {n: sum(b == n for _, b in pairs) for n in range(60)}

    def plain(sources):
        hop = dict.fromkeys(sources, 0)
        todo = list(sources)
        while todo:
            n = todo.pop(0)
            for a, b in pairs:
                if a == n and b not in hop:
                    hop[b] = hop[n] + 1
                    todo.append(b)
        far = max(hop.values()) + 1
        return {n: hop.get(n, far) for n in range(60)}

    several = {}
    for s in ([0], [0, 7, 7, 31]):
        got = {r[0]: r[1] for r in graph.hop_distance(nodes, e, ids(spark, s)).collect()}
        assert got == plain(sorted(set(s)))
        several[len(s)] = got


def test_graph_is_well_formed(f):
    bad = f.edges.where("src = dst OR pos < 0 OR pos >= 10").count()
    assert bad == 0 and f.adj.agg(F.min("degree"), F.max("degree")).first() == (10, 10)
    garbage = f.adj.limit(5).withColumn("degree", F.lit(3))
    assert graph.edges_of(garbage).count() == 15


# orders, masks, bytes -----------------------------------------------------------------


def test_ties_of_orders(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.9), (1, 5.0, 0.1), (2, 5.0, 0.2), (3, 2.0, 0.5)], "node_id long, s double, tie double")
    order = lambda d: [r["node_id"] for r in d.orderBy("rank").collect()]
    assert order(masks.order_by_score(rows, "s", tie=F.col("tie"))) == [1, 2, 3, 0]
    three = spark.createDataFrame([(0, 3.0), (1, 3.0), (2, 1.0)], "node_id long, s double")
    assert order(masks.order_by_score(three, "s")) == [0, 1, 2]


def test_groupings_check_their_order(spark):
    good = spark.createDataFrame([(i, (i * 7) % 50) for i in range(50)], "node_id long, rank long")
    sizes = {r[0]: r[1] for r in masks.rank_grouping(good, 17).groupBy("group_id").count().collect()}
    assert sizes == {0: 17, 1: 17, 2: 16}
    with pytest.raises(ValueError):
        masks.rank_grouping(good, 0)
    with pytest.raises(ValueError):
        masks.rank_grouping(good.withColumn("rank", F.col("rank") + 1), 17)


def test_fractions_use_binary_ceil():
    assert masks.groups_of_fraction(100, 0.07) == 8 and masks.groups_of_fraction(3, 0.0) == 0 and masks.groups_of_fraction(3, 1.0) == 3
    assert masks.groups_of_fraction(100, 0.07) == math.ceil(0.07 * 100)
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            masks.groups_of_fraction(3, bad)


def test_mask_bytes(f, spark):
    sizes = masks.group_bytes(f.grouping("sequential"), f.adj, 16, DIMS)
    total = sizes.agg(F.sum("codes_bytes"), F.sum("adj_bytes_actual"), F.sum("vec_bytes"), F.max(F.col("adj_bytes_actual") - F.col("adj_bytes_reserved"))).first()
    assert total[3] <= 0
    full = masks.masks_from_fractions(spark, f.n_groups, {"all": 1.0, "none": 0.0})
    rows = {r["mask_id"]: r for r in masks.mask_bytes(full, sizes, f.mask_ids(["all", "none"])).collect()}
    assert rows["all"]["total"] == sum(total[:3]) and rows["none"]["total"] == 0.0
    with pytest.raises(ValueError):
        masks.mask_bytes(full, sizes, f.mask_ids(["all"]), "guess")
    with pytest.raises(ValueError):
        masks.node_predicates(f.grouping("sequential"), full, f.mask_ids(["all"]), "a", "b")
    with pytest.raises(ValueError):
        masks.masks_from_groups(spark, {"m": {"OTHER": [1]}})
    with pytest.raises(ValueError):
        corpus.split_workload(f.queries, 1.5)


# metrics ----------------------------------------------------------------------------


def test_toy_ceiling_and_recall(spark):
    truth = spark.createDataFrame([(q, i, 4 * q + i) for q in range(2) for i in range(4)], "query_id long, rank long, node_id long")
    pred = spark.createDataFrame([("m", n, n in (0, 1, 4)) for n in range(8)], "mask_id string, node_id long, codes_ok boolean")
    assert {r["query_id"]: r["ceiling"] for r in metrics.absence_ceiling(truth, pred).collect()} == {0: 0.5, 1: 0.25}
    hits = spark.createDataFrame([("m", 0, 0), ("m", 0, 0), ("m", 0, 1), ("m", 0, 9)], "mask_id string, query_id long, node_id long")
    runs = spark.createDataFrame([("m", 0), ("m", 1)], "mask_id string, query_id long")
    assert {r["query_id"]: r["recall"] for r in metrics.recall_at_k(hits, truth, runs).collect()} == {0: 0.5, 1: 0.0}


# search -----------------------------------------------------------------------------


def results(f, pred, params, strategy):
    hits, stats, expanded = f.search(pred, params, strategy)
    return {tuple(r) for r in hits.withColumn("dist", F.round("dist", 9)).collect()}, {tuple(r) for r in stats.collect()}, {tuple(r) for r in expanded.collect()}


@pytest.mark.parametrize(("length", "width", "io"), [(20, 4, None), (12, 1, None), (30, 8, 17)])
def test_strategies_of_search_agree(f, length, width, io):
    pred = f.pred("random_101", {"f50": 0.5, "f100": 1.0})
    params = search.SearchParams(length, width, K, io)
    assert results(f, pred, params, "bsp") == results(f, pred, params, "arrow")


def test_search_semantics(f):
    full = f.records(f.pred("sequential", {"all": 1.0}), search.SearchParams(64, 8, K)).first()
    assert full["mean_recall"] > 0.6 and full["misses"] == full["code_only"] == 0
    no_vec = f.search(f.pred("sequential", {"m": 1.0}, ("CODES", "ADJ")), search.SearchParams(20, 4, K))[1]
    assert no_vec.where("code_only_count <> num_expanded").count() == 0
    no_adj = f.search(f.pred("sequential", {"m": 1.0}, ("CODES",)), search.SearchParams(20, 4, K))[1]
    assert no_adj.where("hops <> 1 OR num_expanded <> 1 OR miss_count <> 1").count() == 0
    hits, stats, _ = f.search(f.pred("random_101", {"half": 0.5, "none": 0.0}), search.SearchParams(20, 4, K))
    assert stats.where("num_expanded > hops * 4").count() == 0
    none = stats.where("mask_id = 'none'").agg(F.sum("hops"), F.min(F.col("used_fallback").cast("int"))).first()
    assert tuple(none) == (0, 1)
    allowed = f.pred("random_101", {"half": 0.5}).where("codes_ok").select("node_id")
    assert hits.join(allowed, "node_id", "left_anti").count() == 0


def test_recall_never_passes_its_ceiling(f):
    pred = f.pred("random_102", {"a": 0.3, "b": 0.7})
    hits, stats, _ = f.search(pred)
    recall = metrics.recall_at_k(hits, f.truth, stats.select("mask_id", "query_id"))
    both = recall.join(metrics.absence_ceiling(f.truth, pred), ["mask_id", "query_id"])
    assert both.where("recall > ceiling + 1e-9").count() == 0


def test_fallback_needs_hops(f):
    pred = f.pred("random_101", {"none": 0.0})
    with pytest.raises(ValueError):
        search.seeds(search.entry_of(f.queries, f.entries, DIMS), pred, None)
    with pytest.raises(ValueError):
        search.masked_search(f.index, f.queries, pred, None, search.SearchParams(5, 1), "guess")


# curves: published crossings of three corpora, in bytes and normalized recall ------------

POINTS = {  # corpus: order -> the two points around 0.9
    "a": {"sequential": ((4794000000.0, 0.8515910436184762), (5076000000.0, 0.9015777764170391)), "in_degree": ((4230000000.0, 0.8733084318167901), (4512000000.0, 0.9027820300859305)), "random": ((5076000000.0, 0.8989814871512255), (5358000000.0, 0.9491274263670318))},
    "b": {"sequential": ((7216000000.0, 0.8839106425702814), (7380000000.0, 0.9040118808567603)), "in_degree": ((6150000000.0, 0.8918381860776439), (6396000000.0, 0.9086345381526104)), "hop_distance": ((7216000000.0, 0.8873201137884873), (7380000000.0, 0.9062709170013387)), "traversal_frequency": ((7216000000.0, 0.8851029116465864), (7380000000.0, 0.9035307898259706)), "random": ((7216000000.0, 0.8823209504685409), (7380000000.0, 0.9018908969210175))},
    "c": {"sequential": ((26059112364.0, 0.8986960162698889), (26636306176.0, 0.9161861466682617)), "in_degree": ((25251958460.0, 0.8728795310443833), (26113595556.0, 0.9009690154324682)), "hop_distance": ((26650226524.0, 0.8939107548749852), (27233113244.0, 0.9169278621844719)), "traversal_frequency": ((25986480284.0, 0.8932886708936476), (26574908908.0, 0.913147505682498)), "random": ((25986226200.8, 0.8919583682258644), (26574621036.8, 0.9101136499581289))},
}
GB = {"a": {"sequential": 5.067, "random": 5.082, "in_degree": 4.485}, "b": {"sequential": 7.347, "hop_distance": 7.326, "traversal_frequency": 7.349, "random": 7.364, "in_degree": 6.270}, "c": {"in_degree": 26.084, "sequential": 26.102, "traversal_frequency": 26.185, "random": 26.247, "hop_distance": 26.804}}
RATIOS = {"a": 0.885, "b": 0.853, "c": 0.9993}


@pytest.mark.parametrize("corpus_", "abc")
def test_published_crossings_and_ratios(spark, corpus_):
    rows = [(o, x, y) for o, p in POINTS[corpus_].items() for x, y in ((0.0, 0.0), *p)]
    crossed = curves.crossings(spark.createDataFrame(rows, "order string, bytes_total double, normalized_recall double"))
    got = {r["order"]: r["crossing"] / 1e9 for r in crossed.collect()}
    assert got == pytest.approx(GB[corpus_], abs=6e-4)
    verdict = curves.h1_ratio(crossed).first()
    assert verdict["ratio"] == pytest.approx(RATIOS[corpus_], abs=6e-4) and verdict["passed"] is False


def test_crossing_is_the_first_and_may_be_missing(spark):
    rows = [("x", float(i), y) for i, y in enumerate((0.95, 0.5, 0.91, 0.2, 0.99))] + [("y", 0.0, 0.1), ("y", 1.0, 0.2)]
    got = {r[0]: r[1] for r in curves.crossings(spark.createDataFrame(rows, "order string, bytes_total double, normalized_recall double")).collect()}
    assert got["x"] == pytest.approx(1 + 0.4 / 0.41) and got["y"] is None


# sweeps ------------------------------------------------------------------------------


def test_content_key_is_the_published_one():
    groups = list(range(200))
    spec = {"corpus": "deep10m", "grouping_name": "random_seed101", "order_description": "random", "restored_groups": {"CODES": groups, "ADJ": groups, "VEC": groups}, "search_params": {"L": 200, "W": 4, "k": 10, "io_limit": None}, "adj_byte_convention": "actual", "seed": 101, "label": "any"}
    assert sweep.content_key(spec) == "148d79447629f8d6"


def test_run_ids_ignore_labels_only():
    one = sweep.RunSpec("c", "g", "o", {"CODES": [1]}, {"L": 1})
    assert one.run_id() == sweep.RunSpec("c", "g", "o", {"CODES": [1]}, {"L": 1}, label="x").run_id()
    assert one.run_id() != sweep.RunSpec("c", "g", "o", {"CODES": [1]}, {"L": 1}, group_size=5).run_id()
    assert len(sweep.beam_grid([0.02, 0.05, 0.1], [50, 100, 200, 400], [2, 4, 8, 16])) == 21
    with pytest.raises(ValueError):
        sweep.random_seeds([1, 2, 3, 4, 4])


def test_sweeps_resume(spark, tmp_path):
    calls = []

    def evaluate(todo):
        calls.append(sorted(r["run_id"] for r in todo.select("run_id").collect()))
        return todo.withColumn("v", F.lit(len(calls)))

    want = spark.createDataFrame([("a",), ("b",)], "run_id string")
    path = f"file://{tmp_path}/records"
    sweep.append_missing(spark, want, evaluate, path)
    out = sweep.append_missing(spark, want.union(spark.createDataFrame([("c",)], "run_id string")), evaluate, path)
    assert calls == [["a", "b"], ["c"]] and {(r["run_id"], r["v"]) for r in out.collect()} == {("a", 1), ("b", 1), ("c", 2)}
    out = sweep.append_missing(spark, want, evaluate, path, force=True)
    assert {(r["run_id"], r["v"]) for r in out.collect()} == {("a", 3), ("b", 3), ("c", 2)}


# recovery ----------------------------------------------------------------------------


def test_ttrs_needs_the_condition_to_stay(spark):
    w = spark.createDataFrame([(i, r) for i, r in enumerate((0.1, 0.9, 0.5, 0.9, 0.95))], "start long, recall double")
    assert recovery.ttrs(w, F.col("recall") >= 0.9).first()["ttrs"] == 3
    assert recovery.ttrs(w, F.col("recall") >= 0.99).first()["ttrs"] is None
    assert recovery.recall_deficit(w, 0.9, 2.0).first()["deficit"] == pytest.approx((0.8 + 0.4) * 2)


def test_plan_keeps_tiers_in_order(spark):
    units = spark.createDataFrame([(0, "CODES", 10.0, 1.0), (0, "ADJ", 10.0, 90.0), (1, "CODES", 10.0, 50.0), (1, "ADJ", 10.0, 5.0)], "group_id long, tier string, bytes double, gain double")
    got = [(r["group_id"], r["tier"], r["at"]) for r in recovery.greedy_plan(units, 5.0).orderBy("pos").collect()]
    assert got == [(1, "CODES", 2.0), (1, "ADJ", 4.0), (0, "CODES", 6.0), (0, "ADJ", 8.0)]


def test_estimator_learns_a_step(spark):
    rows = spark.createDataFrame([(float(i % 20), float(i % 7), float(i % 20 > 9)) for i in range(200)], "a double, b double, recall double")
    predict = recovery.recall_estimator(rows, ["a", "b"], trees=5, depth=2)
    out = {r["a"]: r["estimate"] for r in predict(rows.select("a", "b").distinct()).collect()}
    assert out[2.0] < 0.2 and out[15.0] > 0.8
