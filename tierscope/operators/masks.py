"""Restore orders, groups of nodes, what their data weigh, and masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.plans.session import global_rank

TIERS = ("CODES", "ADJ", "VEC")
CODE_BYTES = 32


def order_by_score(scores: DataFrame, score: str, descending: bool = True, tie: Column | None = None) -> DataFrame:
    """node_id, rank: by score, then ``tie`` (default: the id)."""
    s = F.col(score).desc() if descending else F.col(score).asc()
    ranked = global_rank(scores, [s, tie if tie is not None else F.col("node_id"), F.col("node_id")], "rank")
    return ranked.select("node_id", "rank")


def rank_grouping(order: DataFrame, group_size: int) -> DataFrame:
    """node_id, group_id: runs of ``group_size`` ranks; ranks must be 0..n-1."""
    if group_size <= 0:
        raise ValueError(f"group_size must be positive: {group_size}")
    n, distinct, lo, hi = order.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    if n and not (n == distinct and lo == 0 and hi == n - 1):
        raise ValueError("the order is no permutation of 0..n-1")
    return order.select("node_id", F.floor(F.col("rank") / group_size).cast("long").alias("group_id"))


def prefix_predicates(groupings: DataFrame, limits: DataFrame) -> DataFrame:
    """node_predicates of many orders in one pass: groupings (order, node_id,
    group_id) and limits (order, mask_id, n_groups), a row for each mask, which has
    all tiers of its order's first n_groups groups."""
    ok = F.col("group_id") < F.col("n_groups")
    return groupings.join(F.broadcast(limits), "order").select("mask_id", "node_id", *[ok.alias(f"{t.lower()}_ok") for t in TIERS])


def prefix_bytes(groupings: DataFrame, limits: DataFrame, adj: DataFrame, dims: int, item_bytes: int = 4, code_bytes: int = CODE_BYTES) -> DataFrame:
    """(order, mask_id, n_groups, bytes_total) of the same masks, by actual lists."""
    node = F.lit(code_bytes + 4 + dims * item_bytes) + 4 * F.coalesce("degree", F.lit(0))
    sizes = groupings.join(adj.select("node_id", "degree"), "node_id", "left").groupBy("order", "group_id").agg(F.sum(node).alias("bytes"))
    sums = sizes.join(F.broadcast(limits), "order").where("group_id < n_groups").groupBy("mask_id").agg(F.sum("bytes").cast("double").alias("bytes_total"))
    return limits.join(sums, "mask_id", "left").na.fill(0.0, ["bytes_total"]).select("order", "mask_id", "n_groups", "bytes_total")


def group_bytes(grouping: DataFrame, adj: DataFrame, slots: int, dims: int, item_bytes: int = 4, code_bytes: int = CODE_BYTES) -> DataFrame:
    """Bytes of each group by tier: actual and reserved lists, codes, vectors."""
    rows = grouping.join(adj.select("node_id", "degree"), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = F.count("*")
    as_double = lambda c: c.cast("double")
    return rows.groupBy("group_id").agg(
        n.alias("n_nodes"),
        as_double(n * code_bytes).alias("codes_bytes"),
        as_double(F.sum(F.lit(4) + 4 * F.col("degree"))).alias("adj_bytes_actual"),
        as_double(n * (4 + 4 * slots)).alias("adj_bytes_reserved"),
        as_double(n * dims * item_bytes).alias("vec_bytes"),
    )


def groups_of_fraction(n_groups: int, fraction: float) -> int:
    """ceil(fraction * n_groups) in binary floating point, on the driver."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be in [0, 1]: {fraction}")
    return math.ceil(fraction * n_groups)


def masks_from_fractions(spark: SparkSession, n_groups: int, fractions: dict[str, float], tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """(mask_id, tier, group_id): the first groups of each fraction, per tier."""
    limits = spark.createDataFrame([(m, groups_of_fraction(n_groups, f)) for m, f in fractions.items()], "mask_id string, n int")
    rows = limits.where("n > 0").select("mask_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("group_id"))
    kinds = F.explode(F.array(*[F.lit(t) for t in tiers])) if tiers else F.explode(F.array().cast("array<string>"))
    return rows.select("mask_id", kinds.alias("tier"), F.col("group_id").cast("long").alias("group_id"))


def masks_from_groups(spark: SparkSession, named: dict[str, dict[str, list[int]]]) -> DataFrame:
    """The same from explicit groups: mask -> tier -> group ids."""
    rows = [(m, t, int(g)) for m, tiers in named.items() for t, groups in tiers.items() for g in groups]
    unknown = {t for _, t, _ in rows} - set(TIERS)
    if unknown:
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    return spark.createDataFrame(rows, "mask_id string, tier string, group_id long")


def node_predicates(grouping: DataFrame, masks: DataFrame, mask_ids: DataFrame, grouping_name: str = "", mask_grouping: str = "") -> DataFrame:
    """(mask_id, node_id, codes_ok, adj_ok, vec_ok) for all nodes and masks.

    A tier without a row isn't restored. Masks belong to one grouping; names
    that differ are an error.
    """
    if grouping_name != mask_grouping:
        raise ValueError(f"mask of {mask_grouping!r} used with grouping {grouping_name!r}")
    flags = masks.groupBy("mask_id", "group_id").agg(*[F.max(F.col("tier") == t).alias(t) for t in TIERS])
    groups = grouping.select("group_id").distinct().crossJoin(F.broadcast(mask_ids))
    flags = groups.join(flags, ["mask_id", "group_id"], "left")
    ok = [F.coalesce(t, F.lit(False)).alias(f"{t.lower()}_ok") for t in TIERS]
    return grouping.join(flags.select("mask_id", "group_id", *ok), "group_id").select("mask_id", "node_id", "codes_ok", "adj_ok", "vec_ok")


def mask_bytes(masks: DataFrame, sizes: DataFrame, mask_ids: DataFrame, convention: str = "actual") -> DataFrame:
    """Bytes of each mask by tier and in total, under either list convention."""
    if convention not in ("actual", "reserved"):
        raise ValueError(f"unknown convention: {convention}")
    other = "reserved" if convention == "actual" else "actual"
    of = lambda tier, c: F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col(c))), F.lit(0.0))
    sums = masks.join(F.broadcast(sizes), "group_id").groupBy("mask_id").agg(of("CODES", "codes_bytes").alias("codes"), of("ADJ", f"adj_bytes_{convention}").alias("adj"), of("VEC", "vec_bytes").alias("vec"), of("ADJ", f"adj_bytes_{other}").alias("adj_other"))
    filled = mask_ids.join(sums, "mask_id", "left").na.fill(0.0, ["codes", "adj", "vec", "adj_other"])
    return filled.select("mask_id", "codes", "adj", "vec", (F.col("codes") + F.col("adj") + F.col("vec")).alias("total"), "adj_other", F.lit(convention).alias("adj_convention"))


def not_cumulative(masks: DataFrame, lower: str, higher: str) -> DataFrame:
    """Groups of mask ``lower`` that mask ``higher`` lacks (none, if cumulative)."""
    a, b = (masks.where(F.col("mask_id") == m).select("tier", "group_id") for m in (lower, higher))
    return a.join(b, ["tier", "group_id"], "left_anti")
