"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op(module: str, function: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        call = getattr(import_module(f"tierscope.llm.{module}"), function)
        return call(*(_table(spark, sf_dir, t) for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bm25_decontamination": _op("decontam", "find_leaks", "documents", "benchmark"),
        "op2_nnls_packing": _op("packing", "pack_documents", "documents"),
        "op3_simhash_neardup": _op("simhash", "simhash_classes", "documents"),
        "op4_tar_media": _op("media", "media_columns", "documents"),
        "op5_suffix_dedup": _op("suffix_dedup", "remove_repeats", "documents"),
        "op8_label_propagation": _op("sharding", "shard_documents", "documents"),
        "op7_bloom_cascade": _op("url_filter", "judge", "pages"),
        "op9_classifier_chain": _op("toxicity", "flag_toxic", "documents", "labels"),
        "op10_bootstrapped_pii": _op("pii", "find_pii", "documents"),
        "op6_pfor_tokens": _op("token_files", "token_documents", "documents"),
    }


def oracle_sql() -> dict[str, str]:
    from tierscope.llm import url_filter

    return {"op7_bloom_cascade": url_filter.JUDGE_SQL}
