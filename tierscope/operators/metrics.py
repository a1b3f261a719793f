"""Recall, its ceiling, run records, and agreement of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.functions import vectors as V


def absence_ceiling(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(mask_id, query_id, ceiling): share of true neighbours whose codes are there."""
    rows = truth.select("query_id", "node_id").join(pred.select("mask_id", "node_id", "codes_ok"), "node_id")
    return rows.groupBy("mask_id", "query_id").agg(F.avg(F.col("codes_ok").cast("int")).alias("ceiling"))


def recall_at_k(hits: DataFrame, truth: DataFrame, runs: DataFrame) -> DataFrame:
    """(mask_id, query_id, recall) for all ``runs``; the width of truth divides,
    ids count once, and runs without hits have 0."""
    width = truth.groupBy("query_id").agg(F.countDistinct("node_id").alias("width"))
    found = hits.select("mask_id", "query_id", "node_id").distinct().join(truth.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi")
    n = found.groupBy("mask_id", "query_id").agg(F.count("*").alias("n"))
    return runs.join(width, "query_id").join(n, ["mask_id", "query_id"], "left").select("mask_id", "query_id", (F.coalesce("n", F.lit(0)) / F.col("width")).alias("recall"))


def run_records(recall: DataFrame, ceiling: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per mask: means, counts, and the values of each query in order."""
    keys = ["mask_id", "query_id"]
    rows = stats.join(recall, keys).join(ceiling, keys)
    listed = F.array_sort(F.collect_list(F.struct("query_id", "recall", "ceiling", "miss_count", "code_only_count", "hops", "num_expanded")))
    out = rows.groupBy("mask_id").agg(F.avg("recall").alias("mean_recall"), F.avg("ceiling").alias("mean_ceiling"), F.sum(F.col("used_fallback").cast("long")).alias("fallbacks"), F.count("*").alias("n_queries"), F.avg("hops").alias("mean_hops"), F.sum("miss_count").alias("misses"), F.sum("code_only_count").alias("code_only"), listed.alias("q"))
    per = F.struct(F.col("q.recall").alias("recall"), F.col("q.ceiling").alias("absence_ceiling"), F.col("q.miss_count").alias("miss_count"), F.col("q.code_only_count").alias("code_only_count"), F.col("q.hops").alias("hops"), F.col("q.num_expanded").alias("num_expanded"))
    return out.withColumn("per_query", per).drop("q")


def agreement(a: DataFrame, b: DataFrame, truth: DataFrame, gate: float = 0.5) -> DataFrame:
    """One row: mean recalls of two results, their gap in percentage points,
    mean overlap, share of equal id sets, and whether the gap passes."""
    ids = lambda d, n: d.groupBy("query_id").agg(F.collect_set("node_id").alias(n))
    rows = ids(truth, "t").join(ids(a, "a"), "query_id").join(ids(b, "b"), "query_id")
    rows = rows.select(V.recall(F.col("a"), F.col("t")).alias("ra"), V.recall(F.col("b"), F.col("t")).alias("rb"), (V.overlap(F.col("a"), F.col("b")) / F.size("b")).alias("both"), V.same_set(F.col("a"), F.col("b")).cast("int").alias("same"))
    out = rows.agg(F.count("*").alias("n_queries"), F.avg("ra").alias("recall_a"), F.avg("rb").alias("recall_b"), F.avg("both").alias("mean_overlap"), F.avg("same").alias("exact_match"))
    return out.withColumn("gap_points", F.abs(F.col("recall_a") - F.col("recall_b")) * 100).withColumn("passed", F.col("gap_points") <= gate)
