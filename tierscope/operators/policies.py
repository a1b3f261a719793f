"""Restore policies as switches of one planner: baselines B0 to B5, ablations A1
to A7, and what they reach over time.

A plan has a row for each policy and unit (group, tier) with the time ``at`` from
which it is there. Units: group_id, tier, bytes, gain, visits (of the traversal),
asked (place in the order of first requests; null if never requested).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.operators import masks
from tierscope.plans.session import global_totals


@dataclass(frozen=True)
class Switch:
    """order: which units come first; whole: a group counts when all its tiers are
    there; ready: units (all at once, after the last) or as they come; beam: how
    much wider searches are; miss: what a search does at a missing unit."""

    order: str
    whole: bool = False
    ready: str = "units"
    beam: float = 1.0
    miss: str = "skip"


SWITCHES: dict[str, Switch] = {
    "greedy": Switch("density", miss="adaptive"),
    "B0": Switch("sequential", ready="replay"),
    "B1": Switch("sequential", ready="rebuild"),
    "B2": Switch("sequential", ready="shards"),
    "B3": Switch("visits", whole=True, miss="fetch"),
    "B4": Switch("asked", whole=True, miss="fetch"),
    "B5": Switch("sequential", beam=2.0),
    "A1": Switch("random"),
    "A2": Switch("gain"),
    "A3": Switch("group_density", whole=True),
    "A4_skip": Switch("density", miss="skip"),
    "A4_fetch": Switch("density", miss="fetch"),
    "A7": Switch("density", beam=2.0, miss="adaptive"),
}
#: Groups of a shard that loads at once (B2).
SHARD = 4


def _stage() -> Column:
    return F.element_at(F.create_map(F.lit("CODES"), F.lit(0), F.lit("ADJ"), F.lit(1), F.lit("VEC"), F.lit(2)), F.col("tier"))


def ordered(units: DataFrame, order: str, seed: int = 5) -> tuple[DataFrame, list[Column]]:
    """Units with what the order needs, and the order; a tier never comes before its
    group's earlier tiers, and ties go to the smaller group."""
    rows = units.withColumn("stage", _stage())
    group = W.partitionBy("group_id")
    tail = [F.col("group_id"), F.col("stage")]
    if order == "sequential":
        return rows, tail
    if order == "random":
        return rows, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string"))), *tail]
    if order == "density":
        so_far = group.orderBy("stage").rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumn("key", F.min(F.col("gain") / F.col("bytes")).over(so_far)), [F.col("key").desc(), *tail]
    if order == "group_density":
        return rows.withColumn("key", F.sum("gain").over(group) / F.sum("bytes").over(group)), [F.col("key").desc(), *tail]
    if order == "gain":
        return rows.withColumn("key", F.sum("gain").over(group)), [F.col("key").desc(), *tail]
    if order == "visits":
        return rows.withColumn("key", F.max("visits").over(group)), [F.col("key").desc(), *tail]
    if order == "asked":
        return rows.withColumn("key", F.min("asked").over(group)), [F.col("key").asc_nulls_last(), *tail]
    raise ValueError(f"unknown order: {order}")


def restore_plan(units: DataFrame, policy: str, rate: float, replay_seconds: float = 0.0, build_seconds: float = 0.0) -> DataFrame:
    """policy, pos, group_id, tier, bytes, at of one policy.

    ``rate``: bytes a second that the token bucket lets through. B0 serves when the
    snapshot is loaded and the log replayed; B1 when the index is rebuilt.
    """
    if policy not in SWITCHES:
        raise ValueError(f"unknown policy: {policy}")
    switch = SWITCHES[policy]
    rows, order = ordered(units, switch.order)
    rows = global_totals(rows, order, {"done": F.col("bytes").cast("double")}, "pos")
    at = F.col("done") / rate
    if switch.whole:
        at = F.max("done").over(W.partitionBy("group_id")) / rate
    elif switch.ready == "shards":
        at = F.max("done").over(W.partitionBy(F.floor(F.col("group_id") / SHARD))) / rate
    elif switch.ready in ("replay", "rebuild"):
        last = rows.agg(F.coalesce(F.max("done"), F.lit(0.0))).first()[0] / rate + replay_seconds
        at = F.lit(float(last if switch.ready == "replay" else build_seconds))
    return rows.select(F.lit(policy).alias("policy"), "pos", "group_id", "tier", "bytes", at.alias("at"))


def restore_plans(units: DataFrame, rate: float, policies: Iterable[str] = tuple(SWITCHES), **seconds: float) -> DataFrame:
    return reduce(DataFrame.unionByName, [restore_plan(units, p, rate, **seconds) for p in policies])


def switches(spark: SparkSession) -> DataFrame:
    """policy, beam, miss: the switches that searches see."""
    return spark.createDataFrame([(p, s.beam, s.miss) for p, s in SWITCHES.items()], "policy string, beam double, miss string")


def latency(reached: DataFrame, settings: DataFrame, total_bytes: float, p99: float, fetch_seconds: float, adaptive_from: float = 0.5) -> DataFrame:
    """(policy, t, p99): the intact index's P99, longer by the wider beam and, where
    misses are fetched, by the share that is missing times a fetch. The adaptive
    policy fetches from the share ``adaptive_from`` on that is there.

    reached: policy, t, bytes; settings: policy, beam, miss.
    """
    rows = reached.join(F.broadcast(settings.select("policy", "beam", "miss")), "policy")  # a row a policy
    there = F.least(F.lit(1.0), F.col("bytes") / total_bytes)
    waits = (F.col("miss") == "fetch") | (F.col("miss") == "adaptive") & (there >= adaptive_from)
    return rows.select("policy", "t", (F.col("beam") * p99 + F.when(waits, (1 - there) * fetch_seconds).otherwise(0.0)).alias("p99"))


def evaluation_greedy(spark: SparkSession, n_groups: int, evaluate: Callable[[DataFrame, list[str]], DataFrame], tiers: tuple[str, ...] = masks.TIERS) -> DataFrame:
    """(step, group_id, recall): the reference order, by measured recall (A6).

    Each step measures all groups that are left at once, as masks of one batch:
    ``evaluate(mask_groups, mask_ids)`` returns (mask_id, recall) for rows
    (mask_id, tier, group_id). The best is taken, the smallest group of ties. Needs
    n_groups² / 2 masks, so it is for few, coarse groups.
    """
    taken: list[int] = []
    steps = []
    while len(taken) < n_groups:
        left = [g for g in range(n_groups) if g not in taken]
        named = {f"g{g:06d}": {t: [*taken, g] for t in tiers} for g in left}
        found = evaluate(masks.masks_from_groups(spark, named), list(named)).collect()  # a row a mask
        recall = {r["mask_id"]: r["recall"] for r in found}
        best = min(left, key=lambda g: (-round(recall[f"g{g:06d}"], 12), g))
        steps.append((len(taken), best, float(recall[f"g{best:06d}"])))
        taken.append(best)
    return spark.createDataFrame(steps, "step long, group_id long, recall double")


def estimator_ablation(rows: DataFrame) -> DataFrame:
    """(estimator, mean_error): mean absolute error of one global estimate, the mean
    of the actual recalls, and of the per-query ones (A5). rows: predicted, actual."""
    mean = rows.agg(F.avg("actual").alias("m"))
    both = rows.crossJoin(F.broadcast(mean))  # one row
    one = lambda name, c: both.agg(F.avg(F.abs(c - F.col("actual"))).alias("mean_error")).select(F.lit(name).alias("estimator"), "mean_error")
    return one("global", F.col("m")).union(one("per_query", F.col("predicted")))
