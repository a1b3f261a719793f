"""Run specifications, their content keys, and resumable sweeps."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RunSpec:
    """Everything that a run's numbers depend on; the label is not part of its key."""

    corpus: str
    grouping_name: str
    order_description: str
    restored_groups: dict[str, list[int]]
    search_params: dict[str, int | None]
    adj_byte_convention: str = "actual"
    seed: int | None = None
    queries: str = ""
    group_size: int | None = None
    split_seed: int | None = None
    tie_seed: int | None = None
    label: str = field(default="", compare=False)

    def run_id(self) -> str:
        """First 16 hex digits of the SHA-256 of the sorted JSON."""
        spec = {k: v for k, v in asdict(self).items() if k != "label"}
        return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:16]


def content_key(spec: dict) -> str:
    """The same key of a plain mapping, leaving out ``label``."""
    return hashlib.sha256(json.dumps({k: v for k, v in spec.items() if k != "label"}, sort_keys=True).encode()).hexdigest()[:16]


def grid(**axes: list) -> list[dict]:
    """All combinations of a sweep's axes."""
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


def beam_grid(fractions: list[float], ls: list[int], ws: list[int], l0: int = 50, w0: int = 4) -> list[tuple[float, int, int]]:
    """Fractions times the L axis (W fixed) and the W axis (L fixed), once each."""
    return list(dict.fromkeys([(f, v, w0) for f in fractions for v in ls] + [(f, l0, v) for f in fractions for v in ws]))


def random_seeds(seeds: list[int]) -> list[int]:
    if len(set(seeds)) < 5:
        raise ValueError("a random order needs at least 5 seeds")
    return seeds


def missing_runs(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested runs (run_id, ...) without a stored record."""
    return requested.join(stored.select("run_id").distinct(), "run_id", "left_anti")


def append_missing(spark: SparkSession, requested: DataFrame, evaluate, path: str, force: bool = False) -> DataFrame:
    """Evaluate and append only what ``path`` lacks; returns all its records.

    ``evaluate`` maps the missing specs to records with a ``run_id``. With
    ``force``, records of requested runs are computed again and replace the old.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    todo = requested if force or not there else missing_runs(requested, spark.read.parquet(path))
    if not todo.isEmpty():
        if force and there:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            evaluate(todo).write.mode("overwrite").partitionBy("run_id").parquet(path)
        else:
            evaluate(todo).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path)
