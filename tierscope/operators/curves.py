"""Restoration curves: averages, normalization, crossings, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.functions import vectors as V

IMPORTANCE = ("in_degree", "hop_distance", "traversal_frequency")


def random_average(points: DataFrame, key: str = "n_groups") -> DataFrame:
    """Seeds of the random order averaged by the number of restored groups."""
    return points.groupBy(key).agg(F.avg("bytes_total").alias("bytes_total"), F.avg("mean_recall").alias("mean_recall"), F.count("*").alias("n_seeds"))


def intact_recall(points: DataFrame) -> DataFrame:
    """One row: the mean recall of all records with a ceiling of 1."""
    return points.where("mean_ceiling = 1.0").agg(F.avg("mean_recall").alias("intact"))


def normalized(points: DataFrame, intact: DataFrame) -> DataFrame:
    return points.crossJoin(F.broadcast(intact)).withColumn("normalized_recall", F.col("mean_recall") / F.col("intact")).drop("intact")


def crossings(curve: DataFrame, target: float = 0.9, value: str = "normalized_recall") -> DataFrame:
    """(order, crossing): bytes where the curve first reaches the target from
    below, on the line between two points; null where it never does."""
    w = W.partitionBy("order").orderBy("bytes_total", value)
    steps = curve.select("order", "bytes_total", F.col(value).alias("y"), F.lag("bytes_total").over(w).alias("x0"), F.lag(value).over(w).alias("y0"))
    hit = steps.where((F.col("y0") < target) & (F.col("y") >= target))
    x = V.crossing(F.col("x0"), F.col("y0"), F.col("bytes_total"), F.col("y"), target)
    first = hit.groupBy("order").agg(F.min_by(x, F.col("bytes_total")).alias("crossing"))
    return curve.select("order").distinct().join(first, "order", "left")


def h1_ratio(crossed: DataFrame, importance: tuple[str, ...] = IMPORTANCE, limit: float = 1 / 3) -> DataFrame:
    """One row: best baseline and importance orders, their ratio, the verdict."""
    known = crossed.where("crossing IS NOT NULL").withColumn("imp", F.col("order").isin(*importance))
    best = lambda c: F.min_by("order", F.when(c, F.col("crossing")))
    low = lambda c: F.min(F.when(c, F.col("crossing")))
    out = known.agg(best(~F.col("imp")).alias("baseline"), low(~F.col("imp")).alias("baseline_bytes"), best(F.col("imp")).alias("importance"), low(F.col("imp")).alias("importance_bytes"))
    return out.withColumn("ratio", F.col("importance_bytes") / F.col("baseline_bytes")).withColumn("passed", F.col("ratio") <= limit)


def tier_contributions(records: DataFrame) -> DataFrame:
    """One row from the stages codes, codes_adj, full: recall and what each tier adds."""
    at = lambda s, c="mean_recall": F.max(F.when(F.col("mask_id") == s, F.col(c)))
    out = records.agg(at("codes").alias("codes_only"), at("codes_adj").alias("with_adj"), at("full").alias("with_vec"), at("codes", "misses").alias("codes_misses"), at("codes_adj", "code_only").alias("adj_code_only"))
    return out.withColumns({"adj_adds": F.col("with_adj") - F.col("codes_only"), "vec_adds": F.col("with_vec") - F.col("with_adj")})


def broken_navigation(records: DataFrame) -> DataFrame:
    """Ceiling minus recall per record: what the graph's gaps cost."""
    return records.withColumn("broken_navigation", F.col("mean_ceiling") - F.col("mean_recall"))
