"""Checkpoint objects by tier and group, rewritten only where a group changed.

An epoch writes its objects below <path>/epoch=E/tier=T/group_id=G as Parquet and
adds rows to <path>/manifest; earlier epochs' objects stay. Reading takes each
object from its newest epoch, so a checkpoint is of mixed epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.operators.recovery import manifest

MANIFEST = "tier string, group_id long, epoch long, digest long, rows long, path string"


def digests(rows: DataFrame) -> DataFrame:
    """(tier, group_id, digest, rows): a sum of row hashes, so order doesn't count.
    rows: tier, group_id, node_id, payload."""
    h = F.xxhash64("node_id", "payload").cast("decimal(20,0)")
    total = F.sum(h) % F.lit(2**62).cast("decimal(20,0)")
    return rows.groupBy("tier", "group_id").agg(total.cast("long").alias("digest"), F.count("*").alias("rows"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all epochs; none where nothing was written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def write_checkpoint(rows: DataFrame, path: str, epoch: int) -> DataFrame:
    """Write the groups whose digest isn't that of their newest object; returns the
    rows added to the manifest. rows: tier, group_id, node_id, payload.

    An epoch that is written again after a failure replaces its own objects.
    """
    spark = rows.sparkSession
    every = read_manifest(spark, path).where(F.col("epoch") < epoch)
    newest = every.groupBy("tier", "group_id").agg(F.max_by("digest", "epoch").alias("had"))
    fresh = digests(rows).join(newest, ["tier", "group_id"], "left").where("had IS NULL OR had <> digest").drop("had")
    added = fresh.select("tier", F.col("group_id").cast("long").alias("group_id"), F.lit(epoch).cast("long").alias("epoch"), "digest", "rows", F.concat(F.lit(f"epoch={epoch}/tier="), "tier", F.lit("/group_id="), F.col("group_id").cast("string")).alias("path"))
    objects = rows.join(fresh.select("tier", "group_id"), ["tier", "group_id"], "left_semi")
    objects.repartition("tier", "group_id").write.mode("overwrite").partitionBy("tier", "group_id").parquet(f"{path}/epoch={epoch}")
    added.write.mode("overwrite").parquet(f"{path}/manifest/written={epoch}")  # last: objects without a row don't count
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/written={epoch}")


def read_checkpoint(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """tier, group_id, node_id, payload, epoch of the newest objects (up to an epoch)."""
    every = read_manifest(spark, path)
    every = every if upto is None else every.where(F.col("epoch") <= upto)
    newest = manifest(every).select("tier", "group_id", "epoch")
    epochs = [r["epoch"] for r in newest.select("epoch").distinct().collect()]  # a few
    parts = None
    for e in sorted(epochs):
        one = spark.read.option("basePath", f"{path}/epoch={e}").parquet(f"{path}/epoch={e}")
        one = one.select(F.col("tier").cast("string").alias("tier"), F.col("group_id").cast("long").alias("group_id"), "node_id", "payload", F.lit(e).cast("long").alias("epoch"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return spark.createDataFrame([], "tier string, group_id long, node_id long, payload string, epoch long")
    return parts.join(newest, ["tier", "group_id", "epoch"], "left_semi")
