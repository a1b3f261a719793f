"""Recovery analytics that are specified only, with no behaviour to match:
time to recover, deficits, planning, log replay, simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.plans.session import global_rank, global_totals


def windowed_quality(log: DataFrame, width: str = "1 second", factor: float = 10.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per window of ``ts``: mean recall, P99 latency, count.

    log: ts, latency, recall. A query slower than ``factor`` times the 99th
    percentile of its keys timed out; it stays, with recall 0.
    """
    far = log.groupBy(*keys).agg(F.expr("percentile(latency, 0.99)").alias("p99"))
    rows = log.join(F.broadcast(far), list(keys)) if keys else log.crossJoin(F.broadcast(far))
    rows = rows.withColumn("recall", F.when(F.col("latency") > factor * F.col("p99"), F.lit(0.0)).otherwise(F.col("recall")))
    out = rows.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.avg("recall").alias("recall"), F.expr("percentile(latency, 0.99)").alias("p99"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "recall", "p99", "n")


def ttrs(windows: DataFrame, ok: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first window from which on the condition always holds; null if never."""
    after = W.partitionBy(*keys).orderBy("start").rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = windows.withColumn("stays", F.min(ok.cast("int")).over(after))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("stays") == 1, F.col("start"))).alias("ttrs"))


def recall_deficit(windows: DataFrame, target: float, seconds: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Integral of what recall lacks to the target."""
    return windows.groupBy(*keys).agg((F.sum(F.greatest(F.lit(0.0), F.lit(target) - F.col("recall"))) * seconds).alias("deficit"))


def h2_ratio(times: DataFrame, system: str, baselines: tuple[str, ...] = ("B3", "B4"), limit: float = 0.5) -> DataFrame:
    """One row from (policy, ttrs): the system over the best baseline."""
    out = times.agg(F.min(F.when(F.col("policy") == system, F.col("ttrs"))).alias("system"), F.min(F.when(F.col("policy").isin(*baselines), F.col("ttrs"))).alias("baseline"))
    return out.withColumn("ratio", F.col("system") / F.col("baseline")).withColumn("passed", F.col("ratio") <= limit)


def greedy_plan(units: DataFrame, rate: float) -> DataFrame:
    """Restore order of units (group_id, tier, bytes, gain) by gain per byte.

    A tier never comes before its group's earlier tiers (codes, adj, vec): its
    key is the least key of its group so far. ``at`` is the time at which a
    token bucket of ``rate`` bytes a second has let the unit through.
    """
    stage = F.element_at(F.create_map(F.lit("CODES"), F.lit(0), F.lit("ADJ"), F.lit(1), F.lit("VEC"), F.lit(2)), F.col("tier"))
    so_far = W.partitionBy("group_id").orderBy("stage").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = units.withColumns({"stage": stage, "density": F.col("gain") / F.col("bytes")}).withColumn("key", F.min("density").over(so_far))
    rows = global_totals(rows, [F.col("key").desc(), F.col("group_id"), F.col("stage")], {"done": F.col("bytes")}, "pos")
    return rows.select("pos", "group_id", "tier", "bytes", "gain", (F.col("done") / rate).alias("at"))


def buckets(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """``ntile`` over the whole table, by global ranks."""
    ranked = global_rank(df, order, "_rank")
    size, more = divmod(df.count(), n)
    edge = more * (size + 1)  # the first buckets have a row more
    late = F.floor((F.col("_rank") - edge) / max(1, size)) + more
    return ranked.withColumn(name, (F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (size + 1))).otherwise(late) + 1).cast("int")).drop("_rank")


def gain_deciles(units: DataFrame, n: int = 10) -> DataFrame:
    rows = buckets(units, [F.col("gain").desc(), F.col("group_id"), F.col("tier")], n, "decile")
    return rows.groupBy("decile").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.avg("gain").alias("mean_gain"))


def miss_policy(rows: DataFrame, policy: str = "adaptive") -> DataFrame:
    """skip, fetch, or by what fetching gains before the deadline.

    rows: eta (seconds to fetch), left (seconds to the deadline), gain."""
    if policy not in ("skip", "fetch", "adaptive"):
        raise ValueError(f"unknown policy: {policy}")
    adaptive = F.when((F.col("eta") <= F.col("left")) & (F.col("gain") > 0), F.lit("fetch")).otherwise(F.lit("skip"))
    return rows.withColumn("action", adaptive if policy == "adaptive" else F.lit(policy))


def replay(log: DataFrame, upto: int | None = None) -> DataFrame:
    """node_id, degree, nbrs: each node's record of the highest lsn (idempotent)."""
    rows = log if upto is None else log.where(F.col("lsn") <= upto)
    last = rows.groupBy("node_id").agg(F.max_by(F.struct("degree", "nbrs", "lsn"), F.col("lsn")).alias("x"))
    return last.select("node_id", "x.degree", "x.nbrs", "x.lsn")


def manifest(objects: DataFrame) -> DataFrame:
    """The newest epoch of each checkpoint object (tier, group_id)."""
    return objects.groupBy("tier", "group_id").agg(F.max("epoch").alias("epoch"), F.max_by("path", "epoch").alias("path"))


def simulate(plan: DataFrame, curve: DataFrame, ticks: DataFrame) -> DataFrame:
    """(policy, t, bytes, recall): what a restore plan has reached at each tick.

    plan: policy, at, bytes; curve: bytes_total, recall (recall of the restored
    bytes); ticks: policy, t. The curve's last point at or below the bytes counts.
    """
    done = plan.select("policy", F.col("at").alias("t"), "bytes").withColumn("tick", F.lit(False))
    marks = ticks.select("policy", "t", F.lit(0.0).alias("bytes"), F.lit(True).alias("tick"))
    so_far = W.partitionBy("policy").orderBy("t", "tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = done.union(marks).withColumn("bytes", F.sum("bytes").over(so_far)).where("tick").drop("tick")
    # as-of lookup: curve points and ticks in one order of bytes
    points = curve.select(F.lit(None).cast("string").alias("policy"), F.lit(None).cast("double").alias("t"), F.col("bytes_total").alias("bytes"), "recall", F.lit(0).alias("side"))
    policies = at.select("policy").distinct()
    points = points.drop("policy").crossJoin(F.broadcast(policies)).select("policy", "t", "bytes", "recall", "side")
    both = points.union(at.select("policy", "t", "bytes", F.lit(None).cast("double").alias("recall"), F.lit(1).alias("side")))
    asof = W.partitionBy("policy").orderBy("bytes", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("recall", F.last("recall", ignorenulls=True).over(asof)).where("side = 1").select("policy", "t", "bytes", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def calibration(rows: DataFrame, n: int = 10) -> DataFrame:
    """Mean predicted minus mean actual recall by bucket of the prediction."""
    b = buckets(rows, [F.col("predicted"), F.col("query_id")], n, "bucket")
    return b.groupBy("bucket").agg(F.avg("predicted").alias("predicted"), F.avg("actual").alias("actual"), (F.avg("predicted") - F.avg("actual")).alias("error"))


def recall_estimator(rows: DataFrame, features: list[str], label: str = "recall", trees: int = 100, depth: int = 4):
    """Boosted trees, then isotonic calibration; returns a function that adds
    ``estimate`` to rows with the features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, IsotonicRegression

    pack = VectorAssembler(inputCols=features, outputCol="_x")
    gbt = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_raw", maxIter=trees, maxDepth=depth, seed=1).fit(pack.transform(rows))
    fitted = gbt.transform(pack.transform(rows))
    iso = IsotonicRegression(featuresCol="_raw", labelCol=label, predictionCol="estimate").fit(fitted)
    return lambda new: iso.transform(gbt.transform(pack.transform(new))).drop("_x", "_raw")
