"""Queries over files, checkpoints, streams and restore policies.

Files are written below the shared folder first and then read by the sources, so a
query's rows have been through the layout that it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.functions import udtf
from tierscope.operators import checkpoints, graph, masks, metrics, policies, pq, recovery, search
from tierscope.plans.catalog import CURVE, DIMS, FRACTIONS, K, NAMED, SLOTS, Fixture, _ids
from tierscope.plans.session import cut, shared_dir
from tierscope.sources import formats
from tierscope.streaming import quality

RATE, TICKS, COARSE = 1e4, 30, 5


def _place(f: Fixture, name: str) -> str:
    return f"{shared_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


def _matrix(f: Fixture, rows: DataFrame, dtype: str) -> str:
    """A matrix file of (row_id, values)."""
    formats.register(f.spark)
    path = _place(f, "matrix") + ".bin"
    rows.write.format("matrixfile").mode("append").option("dtype", dtype).save(path)
    return path


def _vectors(f: Fixture) -> str:
    return _matrix(f, f.base.select(F.col("node_id").alias("row_id"), F.col("vec").alias("values")), "f4")


def _scan(f: Fixture) -> DataFrame:
    return f.spark.read.format("matrixfile").option("rows", 100).load(_vectors(f)).select("row_id", F.col("values")[0].alias("x0"), F.col("values")[DIMS - 1].alias("x63"))


def _header(f: Fixture) -> DataFrame:
    return f.spark.createDataFrame([formats.header(_vectors(f))], "rows long, cols long")


def _result_ids(f: Fixture) -> DataFrame:
    lists = f.truth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id"))).alias("x"))
    path = _matrix(f, lists.select(F.col("query_id").alias("row_id"), F.col("x.node_id").cast("array<double>").alias("values")), "u4")
    rows = f.spark.read.format("matrixfile").option("dtype", "u4").load(path)
    return rows.select(F.col("row_id").alias("query_id"), F.posexplode("values").alias("rank", "node_id")).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("node_id").cast("long").alias("node_id"))


def _truth(f: Fixture) -> DataFrame:
    path = _place(f, "truth") + ".bin"
    formats.write_truth(f.truth, path)
    return formats.read_truth(f.spark, path, rows=7)


def _index(f: Fixture) -> str:
    """An index file of the fixture's graph, written a sector at a time."""
    path = _place(f, "index") + ".index"
    rows = f.adj.join(f.base.select("node_id", "vec"), "node_id").orderBy("node_id").select("vec", "nbrs")
    formats.write_index_rows(path, ((r["vec"], r["nbrs"]) for r in rows.toLocalIterator()), f.base.count(), DIMS, SLOTS, int(f.medoid.first()["node_id"]))
    formats.register(f.spark)
    return path


def _index_meta(f: Fixture) -> DataFrame:
    m = formats.index_meta(_index(f), "f4")
    return f.spark.createDataFrame([(m.npts, m.ndims, m.medoid, m.node_bytes, m.per_sector, m.slots, m.file_size)], "npts long, ndims long, medoid long, node_bytes long, per_sector long, slots long, file_size long")


def _index_scan(f: Fixture) -> DataFrame:
    return f.spark.read.format("graphindex").option("rows", 100).load(_index(f))


def _offsets(f: Fixture) -> DataFrame:
    """Where every record is, from the metadata alone."""
    m = formats.index_meta(_index(f), "f4")
    at = (F.floor(F.col("node_id") / m.per_sector) + 1) * formats.SECTOR + (F.col("node_id") % m.per_sector) * m.node_bytes
    return f.nodes.select("node_id", at.cast("long").alias("offset"))


def _lookups(f: Fixture) -> DataFrame:
    """A pushed range of nodes at a time, over all nodes."""
    path, n = _index(f), f.base.count()
    read = lambda lo, hi: f.spark.read.format("graphindex").load(path).where((F.col("node_id") >= lo) & (F.col("node_id") < hi))
    middle = n // 3
    return read(0, middle).union(read(middle, n)).select("node_id", "degree", F.col("nbrs")[0].alias("first"))


def _pivots(f: Fixture) -> DataFrame:
    book = pq.codebook(f.base, DIMS, pq.CHUNKS, 256).collect()  # 256 centroids
    step, path = DIMS // pq.CHUNKS, _place(f, "pivots") + ".bin"
    centroids = np.zeros((256, DIMS), "<f4")
    for r in book:
        centroids[r["centroid"], r["chunk"] * step : (r["chunk"] + 1) * step] = r["sub"]
    formats.write_pivots(path, centroids, np.array(f.center.first()["center"], "<f4"), np.arange(pq.CHUNKS + 1, dtype="<u4") * step)
    table, _ = formats.read_pivots_tables(f.spark, path)
    return table.select("chunk", "centroid", F.round(F.col("sub")[0], 4).alias("a"), F.round(F.col("sub")[1], 4).alias("b"))


def _entry_files(f: Fixture) -> DataFrame:
    base, rows = _place(f, "entries"), f.label_entries.orderBy("ord").collect()  # a few entry points
    formats.write_section(f"{base}_medoids.bin", np.array([[r["node_id"]] for r in rows], "<u4"), "u4")
    formats.write_section(f"{base}_centroids.bin", np.array([r["vec"] for r in rows], "<f4"), "f4")
    ids, vectors = formats.entry_points(base, "f4")
    return f.spark.createDataFrame([(k, i, float(v[0])) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))], "ord long, node_id long, x0 double")


def _records(f: Fixture) -> DataFrame:
    """A record a mask, with its groups as a map, as JSON and back."""
    folder = _place(f, "records")
    groups = F.create_map(*[x for t in masks.TIERS for x in (F.lit(t), F.col(t.lower()))])
    f.bytes("in_degree", FRACTIONS).select("mask_id", "total", groups.alias("tiers"), F.col("mask_id").alias("run")).repartition("run").write.partitionBy("run").json(folder)
    rows = formats.read_records(f.spark, folder, "mask_id string, total double, tiers map<string,double>")
    return rows.select("mask_id", "total", F.explode("tiers").alias("tier", "bytes"))


def _curve_points(f: Fixture) -> DataFrame:
    ceiling = metrics.absence_ceiling(f.truth, f.pred("sequential", CURVE)).groupBy("mask_id").agg(F.avg("ceiling").alias("mean_recall"))
    points = f.bytes("sequential", CURVE).select("mask_id", F.col("total").alias("bytes_total")).join(ceiling, "mask_id")
    return points.select(F.lit("sequential").alias("order"), "bytes_total", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_recall", 6).alias("normalized_recall"))


def _curve_file(f: Fixture) -> DataFrame:
    folder = _place(f, "curve")
    formats.write_curve(_curve_points(f), folder)
    return formats.read_curve(f.spark, folder)


def _report(f: Fixture) -> DataFrame:
    folder, report = _place(f, "report"), metrics.agreement(f.adc_hits, f.truth, f.truth)
    formats.write_report(report, folder)
    return f.spark.read.schema(report.schema).json(folder)


def _expand(f: Fixture) -> DataFrame:
    udtf.register(f.spark)
    rows = [(m, t, g) for m, tiers in NAMED.items() for t, g in tiers.items()]
    f.spark.createDataFrame(rows, "mask_id string, tier string, groups array<bigint>").createOrReplaceTempView("mask_specs")
    return f.spark.sql("SELECT e.* FROM mask_specs s, LATERAL expand_mask(s.mask_id, s.tier, s.groups) e")


# streams --------------------------------------------------------------------------


def _streamed(f: Fixture) -> DataFrame:
    """The query log as a stream, in one run over what there is."""
    folder, out = _place(f, "log"), _place(f, "stream")
    f.log.write.parquet(folder)
    p99 = f.log.agg(F.expr("percentile(latency, 0.99)")).first()[0]
    stream = quality.windowed(f.spark.readStream.schema(f.log.schema).parquet(folder), p99, "1 hour", factor=1.02)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return f.spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "recall", "n")


# checkpoints -----------------------------------------------------------------------


def _objects(f: Fixture, changed: bool) -> DataFrame:
    rows = f.grouping("sequential").join(f.adj, "node_id").withColumn("list", F.array_join("nbrs", ","))
    later = F.when(F.lit(changed) & (F.col("group_id") % 3 == 0), F.lit("+")).otherwise(F.lit(""))
    adj = rows.select(F.lit("ADJ").alias("tier"), "group_id", "node_id", F.concat("list", later).alias("payload"))
    return adj.union(rows.select(F.lit("CODES").alias("tier"), "group_id", "node_id", F.col("degree").cast("string")))


def _checkpointed(f: Fixture) -> str:
    path = _place(f, "epochs")
    checkpoints.write_checkpoint(_objects(f, False), path, 1)
    checkpoints.write_checkpoint(_objects(f, True), path, 2)
    return path


def _objects_written(f: Fixture) -> DataFrame:
    return checkpoints.read_manifest(f.spark, _checkpointed(f)).select("tier", "group_id", "epoch", "rows", "path")


# policies --------------------------------------------------------------------------


def _units(f: Fixture) -> DataFrame:
    """Restore units with how often, and how early, the traversal asks for a group."""
    done = f.search(f.pred("sequential", {"all": 1.0}))[2]
    by = done.join(f.grouping("sequential"), "node_id").groupBy("group_id").agg(F.count("*").alias("visits"), F.min(F.col("query_id") * 100_000 + F.col("hop")).alias("asked"))
    return cut(f.units.join(by, "group_id", "left").withColumn("visits", F.coalesce("visits", F.lit(0))))


def _plans(f: Fixture) -> DataFrame:
    return policies.restore_plans(_units(f), RATE, replay_seconds=2.0, build_seconds=25.0)


def _simulated(f: Fixture) -> DataFrame:
    """policy, t, bytes, recall, p99 of every policy."""
    total = f.units.agg(F.sum("bytes").alias("b"))
    steps = total.select(F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"), "b")
    curve = steps.select((F.col("i") * F.col("b") / 10).alias("bytes_total"), (F.col("i") / 10).alias("recall"))
    ticks = f.spark.createDataFrame([(p, float(t)) for p in policies.SWITCHES for t in range(TICKS)], "policy string, t double")
    reached = recovery.simulate(_plans(f).select("policy", "at", "bytes"), curve, ticks)
    late = policies.latency(reached, policies.switches(f.spark), float(total.first()["b"]), 0.1, 0.4)
    return reached.join(late, ["policy", "t"])


def _coarse(f: Fixture) -> DataFrame:
    return cut(masks.rank_grouping(cut(f.order("in_degree")), -(-f.base.count() // COARSE)))


def _greedy_order(f: Fixture) -> DataFrame:
    grouping = _coarse(f)

    def evaluate(rows: DataFrame, names: list[str]) -> DataFrame:
        pred = masks.node_predicates(grouping, rows, f.mask_ids(names))
        return f.records(pred, search.SearchParams(20, 4, K)).select("mask_id", F.col("mean_recall").alias("recall"))

    return policies.evaluation_greedy(f.spark, COARSE, evaluate)


def _estimates(f: Fixture) -> DataFrame:
    return _ids(f.truth, "t").join(_ids(f.adc_hits, "a"), "query_id").select("query_id", (F.col("query_id") / 50).alias("predicted"), (F.size(F.array_intersect("a", "t")) / K).alias("actual"))


def _estimator(f: Fixture) -> DataFrame:
    """Boosted trees over what each query lost, on all masks of the sweep."""
    hits, stats, _ = f.search(f.pred("random_101", FRACTIONS))
    recall = metrics.recall_at_k(hits, f.truth, stats.select("mask_id", "query_id"))
    features = ["hops", "num_expanded", "miss_count", "code_only_count"]
    rows = cut(stats.join(recall, ["mask_id", "query_id"]))
    predict = recovery.recall_estimator(rows, features, trees=20)
    return predict(rows).select("mask_id", "query_id", "recall", "estimate")


Q: dict[str, Callable[[Fixture], DataFrame]] = {
    "source_matrix_header": _header,
    "source_matrix_scan": _scan,
    "source_result_ids": _result_ids,
    "source_truth": _truth,
    "source_index_meta": _index_meta,
    "source_index_nodes": lambda f: _index_scan(f).select("node_id", "degree", F.col("vec")[0].alias("x0"), F.col("vec")[DIMS - 1].alias("x63")),
    "source_index_edges": lambda f: graph.edges_of(_index_scan(f)),
    "source_index_offsets": _offsets,
    "source_index_lookup": _lookups,
    "source_pivots": _pivots,
    "source_entry_points": _entry_files,
    "source_records": _records,
    "source_curve_csv": _curve_file,
    "report_json": _report,
    "expand_mask": _expand,
    "stream_windowed_quality": _streamed,
    "arrivals_poisson": lambda f: quality.arrivals_batch(f.base.count(), 20.0, f.spark),
    "checkpoint_objects": _objects_written,
    "checkpoint_read": lambda f: checkpoints.read_checkpoint(f.spark, _checkpointed(f)),
    "checkpoint_read_epoch": lambda f: checkpoints.read_checkpoint(f.spark, _checkpointed(f), 1).drop("epoch"),
    "restore_policies": _plans,
    "simulate_all_policies": _simulated,
    "estimator_ablation": lambda f: policies.estimator_ablation(_estimates(f)),
    "recall_estimator": _estimator,
    "evaluation_greedy_order": _greedy_order,
    "pq_trained_codebook": lambda f: pq.trained(f.base, DIMS, centroids=16, rounds=1).select("chunk", "centroid", F.col("sub")[0].alias("a"), F.col("sub")[1].alias("b")),
    "pq_trained_256": lambda f: pq.trained(f.base, DIMS).select("chunk", "centroid", F.col("sub")[0].alias("a"), F.col("sub")[1].alias("b")),
    "robust_prune_edges": lambda f: graph.pruned_graph(f.base, f.edges, 10),
}
