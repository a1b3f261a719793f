"""Structured Streaming: windowed quality, smoothed latencies, mutation logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.plans.session import global_totals


def windowed(log: DataFrame, p99: float, width: str = "1 second", late: str = "10 seconds", factor: float = 10.0) -> DataFrame:
    """Per window: mean recall, P99 (approximate), count; late rows are dropped
    after the watermark. ``p99`` is the healthy percentile; slower queries than
    ``factor`` times it timed out and count as recall 0."""
    rows = log.withWatermark("ts", late).withColumn("recall", F.when(F.col("latency") > factor * p99, F.lit(0.0)).otherwise(F.col("recall")))
    out = rows.groupBy(F.window("ts", width).alias("w")).agg(F.avg("recall").alias("recall"), F.percentile_approx("latency", 0.99).alias("p99"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "recall", "p99", "n")


def arrivals(spark, per_second: int, seed: int = 3) -> DataFrame:
    """Open-loop arrivals: a rate source whose rows get exponential gaps in time."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    jitter = -F.log(F.greatest(F.rand(seed), F.lit(1e-12))) / per_second
    return rate.select(F.col("value").alias("query_id"), (F.col("timestamp").cast("double") + jitter).cast("timestamp").alias("ts"))


def arrivals_batch(n: int, per_second: float, spark, seed: int = 3) -> DataFrame:
    """(query_id, at): the same arrivals computed ahead, seconds from the start.

    Gaps are exponential in a uniform number from a hash of the seed and the id, so
    a replay has the same arrivals, on any number of executors."""
    ids = spark.range(n).withColumnRenamed("id", "query_id")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return global_totals(ids, [F.col("query_id")], {"at": -F.log(u) / per_second}).select("query_id", "at")


def smoothed(latencies: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted latency by tier and source, kept as state.

    latencies: tier, source, ts, latency (a stream)."""

    def update(key, frames, state):
        value = state.get[0] if state.exists else None
        for pdf in frames:
            for x in pdf.sort_values("ts")["latency"]:
                value = float(x) if value is None else alpha * float(x) + (1 - alpha) * value
        state.update((value,))
        yield pd.DataFrame({"tier": [key[0]], "source": [key[1]], "ewma": [value]})

    return latencies.groupBy("tier", "source").applyInPandasWithState(update, "tier string, source string, ewma double", "ewma double", "update", "NoTimeout")


def smoothed_batch(latencies: DataFrame, alpha: float = 0.2) -> DataFrame:
    """The same over a finished log, as a fold over each ordered list."""
    lists = latencies.groupBy("tier", "source").agg(F.array_sort(F.collect_list(F.struct("ts", "latency"))).alias("x"))
    fold = F.aggregate("x", F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v["latency"]).otherwise(alpha * v["latency"] + (1 - alpha) * s))
    return lists.select("tier", "source", fold.alias("ewma"))


def replayed(log: DataFrame) -> DataFrame:
    """Each node's record of the highest lsn so far (a stream, update mode).

    log: lsn, node_id, degree, nbrs. Records that come again or too late change
    nothing."""

    def update(key, frames, state):
        lsn, degree, nbrs = state.get if state.exists else (-1, 0, [])
        for pdf in frames:
            top = pdf.loc[pdf["lsn"].idxmax()]
            if int(top["lsn"]) > lsn:
                lsn, degree, nbrs = int(top["lsn"]), int(top["degree"]), [int(x) for x in top["nbrs"]]
        state.update((lsn, degree, nbrs))
        yield pd.DataFrame({"node_id": [key[0]], "lsn": [lsn], "degree": [degree], "nbrs": [nbrs]})

    return log.groupBy("node_id").applyInPandasWithState(update, "node_id long, lsn long, degree int, nbrs array<long>", "lsn long, degree int, nbrs array<long>", "update", "NoTimeout")


def truncated(log: DataFrame, low_water: int) -> DataFrame:
    """Records that a checkpoint at ``low_water`` doesn't cover yet."""
    return log.where(F.col("lsn") > low_water)
