from __future__ import annotations

import re

from pyspark.sql import functions as F

from tilewright.plans import catalogue


def test_masks_of_the_same_pixels_are_not_broadcast(spark, tmp_path):
    """Pixels are planned as small as the slides they come from, but grow with them."""
    spark.range(3).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    masks = catalogue.QUERIES["x8_channel_thresholds"](spark, str(tmp_path))
    joins = re.findall(r"(\w+Join) \[slide_id#\d+L?, row#\d+L?, col#\d+L?\]", masks._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    assert masks.columns == ["slide_id", "row", "col", "fg", "dark"] and masks.count() == 3 * 32 * 24
