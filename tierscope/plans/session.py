"""Small helpers on sessions: reliable cuts of lineage, and global ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows up to which one task ranks a whole table.
SMALL = 100_000


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder (spark.checkpoint.dir). Rounds of a loop
    then survive lost executors. See ``shared_dir``."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a
    local master gets one of our own where none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", small: int = SMALL) -> DataFrame:
    """Gapless ranks from 0 over the whole table.

    Beyond ``small`` rows: range partitions, sorted each, plus the sizes of the
    partitions before; so no task sees more than its share.
    """
    if len(df.take(small + 1)) <= small if small < 1000 else df.count() <= small:
        return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))  # one row per partition
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_i") - F.col("_first") + F.col("_base")).drop("_p", "_i", "_first", "_base")


def global_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "rank", small: int = SMALL) -> DataFrame:
    """``global_rank``, and running totals (name -> summed column) in that order,
    each row's own value included. Only sums by partition are in one task."""
    ranked = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    if df.count() <= small:
        so_far = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        ranked = ranked.withColumns({name: (F.row_number().over(W.orderBy(*order)) - 1).cast("long"), **{n: F.sum(f"_v_{n}").over(so_far) for n in sums}})
        return ranked.drop(*[f"_v_{n}" for n in sums])
    ranked = cut(global_rank(ranked, order, name, small))
    part = F.floor(F.col(name) / small).cast("long")
    per = ranked.groupBy(part.alias("_p")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("_p", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])  # a row for each ``small`` rows
    so_far = W.partitionBy("_p").orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranked.withColumn("_p", part).join(per, "_p").withColumns({n: F.sum(f"_v_{n}").over(so_far) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_p", *[f"_{x}_{n}" for n in sums for x in "vb"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
