from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tilewright import config
from tilewright.operators import triage
from tilewright.plans import proxies


def test_cut_off_boundaries(spark):
    counts = spark.createDataFrame([(n, n) for n in (0, 3, 4, 39, 40, 41)], "slide_id int, positive_tiles int")
    got = {r.slide_id: r.algorithm_result for r in triage.triage(counts, 3, 40).collect()}
    assert got == {0: 1, 3: 1, 4: 2, 39: 2, 40: 3, 41: 3}


def test_threshold_is_strict_and_empty_slides_stay(spark):
    tiles = spark.createDataFrame([("a", 0.99), ("a", 0.991), ("b", 0.5)], "slide_id string, p double")
    got = {r.slide_id: r.positive_tiles for r in triage.positive_tiles(tiles, "p", 0.99).collect()}
    assert got == {"a": 1, "b": 0}


def test_records_choose_the_annotation_and_leave_negatives_empty(spark):
    results = spark.createDataFrame([(1, 4, 2), (2, 0, 1)], "slide_id int, positive_tiles int, algorithm_result int")
    slides = spark.createDataFrame([(1, "22A1 P 7.ndpi"), (2, "22A2 P.ndpi")], "slide_id int, slide_name string")
    rows = {r.sample_id: r for r in triage.slide_records(results, slides, "m1", ("xml", "ndpa")).collect()}
    assert rows["22A1"].tile_mapping == "22A1 P 7.ndpi.ndpa"
    assert rows["22A1"].slide_filename == "22A1 P 7"
    assert rows["22A2"].tile_mapping is None


def test_hot_slide_keeps_every_row_in_order(spark):
    """Most rows on one slide with a single score: nothing is lost and the order is total."""
    tiles = spark.range(6000).select(
        F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7).alias("slide_id"),
        F.when(F.col("id") % 10 < 8, 1.0).otherwise(F.col("id") / 6000.0).alias("p"),
        (F.col("id") % 50).alias("x_min"), (F.col("id") % 60).alias("y_min"), F.col("id").alias("tile_id"))
    placed = triage.positives_ordered(tiles, "p", -1.0).collect()
    assert len(placed) == 6000
    by_slide: dict = {}
    for r in placed:
        by_slide.setdefault(r.slide_id, []).append(r)
    for rows in by_slide.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(1, len(rows) + 1))
        keys = [(-r.p, r.x_min, r.y_min, r.tile_id) for r in rows]
        assert keys == sorted(keys)


def test_unknown_stain_raises(spark):
    rows = spark.createDataFrame([("he",), ("zz",)], "stain string")
    with pytest.raises(PySparkException, match="unknown stain"):
        config.with_stain_config(rows).collect()
    with pytest.raises(ValueError):
        config.settings("zz")


def test_tff3_class_cannot_be_overridden(spark):
    rows = spark.createDataFrame([("he",), ("tff3",)], "stain string")
    got = {r.stain: r.ranked_class for r in config.with_stain_config(rows, ranked_class=F.lit("Negative")).collect()}
    assert got == {"he": "Negative", "tff3": "Positive"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not mounted")
def test_known_counts_of_the_stand_in(spark):
    tiles = proxies.tile_scores(spark, "/root/testdata/sf0.01")
    counts = triage.positive_tiles(tiles, "score", 0.99).cache()
    by_rest = {r.k: r.n for r in counts.groupBy((F.col("slide_id") % 5).alias("k")).agg(F.sum("positive_tiles").alias("n")).collect()}
    assert by_rest == {0: 101, 1: 68, 2: 25, 3: 0, 4: 0}
    for (lcp, hcp), want in {(0, 10): (49, 48, 3), (0, 95): (49, 51, 0), (0, 2): (49, 10, 41), (3, 40): (73, 27, 0)}.items():
        tally = triage.run_tally(triage.triage(counts, lcp, hcp)).first()
        assert (tally.negative, tally.low, tally.high) == want
