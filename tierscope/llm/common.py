"""Shared helpers: the folder that all executors see, written tables, ranks, links.

Every helper here keeps its work distributed; only counters leave the executors.
"""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tierscope.plans.session import shared_dir

_MADE: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``shared_dir``; removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop_dir(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: later jobs survive lost executors, and values that
    depend on the partitioning (row ids) stay as they are.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files behind ``written`` frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            drop_dir(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files of finished jobs
    are deleted now and don't add up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_keys(df: DataFrame, keys: list[str], parts: int = 1_000) -> DataFrame | None:
    """The keys that hold over 1 / ``parts`` of df's rows, fewer than ``parts``; None
    if there are none. df is read several times and should be written."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(100, df.count() // parts)).drop("_n")
    hot = written(hot, "hot-keys")
    return None if hot.isEmpty() else hot


_LOOK = object()


def join_few(df: DataFrame, few: DataFrame, keys: list[str], how: str = "left", hot: DataFrame | None = _LOOK) -> DataFrame:
    """``df`` joined (left or inner) with ``few``, which has one row a key at most;
    keys aren't null.

    Rows of ``few`` for the hot keys of df (``hot_keys``, a bounded number) are
    broadcast. The others are shuffled, where rows of hot keys get keys by their
    place, so no task gets all rows of such a key.
    """
    hot = hot_keys(df, keys) if hot is _LOOK else hot
    if hot is None:
        return df.join(few, keys, how)
    values = [c for c in few.columns if c not in keys]
    there = few.select(*keys, F.struct(F.lit(True).alias("in"), *values).alias("_few"))
    none = F.struct(F.lit(False).alias("in"), *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in values])
    found = written(hot.join(there, keys, "left").select(*keys, F.coalesce("_few", none).alias("_hot")), "hot-few")
    tagged = df.join(F.broadcast(found), keys, "left")
    away = F.xxhash64(F.monotonically_increasing_id())
    spread = [F.when(F.col("_hot").isNull(), F.col(k)).otherwise(away.cast(df.schema[k].dataType)).alias(f"_key_{i}") for i, k in enumerate(keys)]
    right = there.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    out = tagged.select("*", *spread).join(right, [f"_key_{i}" for i in range(len(keys))], "left")
    got = F.coalesce("_hot", "_few")
    if how == "inner":
        out = out.where(got["in"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[got[c].alias(c) for c in values])


def text_hash(col: str = "text") -> list:
    """128 bits of a text as two long columns t1 and t2; null counts as empty."""
    text = F.coalesce(F.col(col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(0x51ED27), text).alias("t2")]


def salts(df: DataFrame) -> int:
    """Parts that a hot key is split into; follows the shuffle width."""
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within ``keys``; no task holds a whole hot key.

    Rows get a salt from ``order`` (which must identify a row), are ranked in
    (keys, salt), and shifted by the counts of the smaller salts.
    """
    n = salts(df)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    part = salted.withColumn("_r", F.row_number().over(inner) - 1)
    same = [part[k].eqNullSafe(offsets[k]) for k in [*keys, "_salt"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return part.join(offsets, cond).select(*[part[c] for c in df.columns], (part["_r"] + offsets["_base"]).cast("long").alias(name))


def connected(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of (a, b) long pairs: (node, root), root the least.

    Alternating large-star and small-star steps; every step's edges are
    written, and only a count and a checksum come to the driver. Nodes without
    edges don't appear.
    """
    spark = edges.sparkSession
    pair = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    now = written(edges.where("a <> b").select(*pair("a", "b")).distinct(), name)
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    was = mark(now)
    if not was[0]:
        return spark.createDataFrame([], "node long, root long")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, name)
        is_now = mark(new)
        forget(now, large)
        now = new
        if is_now == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = is_now


def in_blocks(df: DataFrame, keys: list[str], row: str, cap: int) -> DataFrame:
    """Add block numbers (bi, bj): any two rows of a key meet in some block pair.

    Keys of up to ``cap`` rows stay whole (0, 0). Larger keys are cut into
    chunks by a hash of ``row``, and each pair of chunks is a group of its own,
    so no group holds more than about twice ``cap`` rows and no pair is lost.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > cap)
    if hot.isEmpty():
        return df.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    hot = written(hot.withColumn("_k", F.ceil(F.col("_n") / cap).cast("int")).drop("_n"), "hot")
    out = df.join(hot, keys, "left").withColumn("_c", F.pmod(F.xxhash64(row), F.coalesce("_k", F.lit(1))).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)))
    return out.withColumns({"bi": F.least("_c", "_o"), "bj": F.greatest("_c", "_o")}).drop("_c", "_o", "_k")


def only(df: DataFrame, **columns: T.DataType) -> DataFrame:
    """Just the named columns, so that clashing extra columns can't interfere."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])
