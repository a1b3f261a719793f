"""Base vectors, held-out queries, and workload splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.plans.session import global_rank


def shuffled(seed: int, column: str) -> list[Column]:
    """A seeded random order that any engine can repeat: md5, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))), F.col(column)]


def held_out(embeddings: DataFrame, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(base, queries): n sampled rows become queries, the others the base.

    Ids are compacted to 0.. in the order of vec_id on both sides.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    picked = rows.select("vec_id").orderBy(*shuffled(seed, "vec_id")).limit(n)
    base = rows.join(picked, "vec_id", "left_anti")
    queries = rows.join(picked, "vec_id", "left_semi")
    base = global_rank(base, [F.col("vec_id")], "node_id")
    queries = global_rank(queries, [F.col("vec_id")], "query_id")
    return base.select("node_id", "vec", "label", "vec_id"), queries.select("query_id", F.col("vec").alias("qvec"), "vec_id")


def split_workload(queries: DataFrame, fraction: float = 0.5, seed: int = 1234) -> DataFrame:
    """query_id, pos, workload: a random permutation cut at round(n * fraction)."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be in [0, 1]: {fraction}")
    cut = round(queries.count() * fraction)
    ranked = global_rank(queries.select("query_id"), shuffled(seed, "query_id"), "pos")
    return ranked.withColumn("workload", F.col("pos") < cut)
