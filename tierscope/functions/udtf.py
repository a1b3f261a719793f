"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="mask_id string, tier string, group_id bigint")
class ExpandMask:
    """``LATERAL expand_mask(mask_id, tier, groups)``: a row for each group of a mask;
    none for null or empty groups, one for a group that is given twice."""

    def eval(self, mask_id: str, tier: str, groups: list):
        for g in sorted(set(groups or [])):
            yield mask_id, tier, g


def register(spark: SparkSession) -> None:
    spark.udtf.register("expand_mask", ExpandMask)
