from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as geo
from tilewright.operators import tiling

POINT = "array<struct<x: bigint, y: bigint>>"
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
CONCAVE = [(0, 0), (12, 0), (12, 4), (4, 4), (4, 12), (0, 12)]


def polygon(spark, pts):
    return spark.createDataFrame([([(x, y) for x, y in pts],)], f"points {POINT}").withColumn("ring", geo.edges(F.col("points")))


@pytest.mark.parametrize("pts,point,want", [
    (SQUARE, (5, 5), 1), (SQUARE, (10, 5), 2), (SQUARE, (0, 0), 2), (SQUARE, (11, 5), 0), (SQUARE, (-1, 0), 0), (SQUARE, (-1, 10), 0),
    (CONCAVE, (8, 8), 0), (CONCAVE, (2, 8), 1), (CONCAVE, (4, 4), 2), (CONCAVE, (4, 8), 2), (CONCAVE, (8, 4), 2), (CONCAVE, (2, 4), 1),
])
def test_position(spark, pts, point, want):
    x, y = (F.lit(v).cast("bigint") for v in point)
    assert polygon(spark, pts).select(geo.position(F.col("ring"), x, y).alias("p")).first().p == want


def test_position_against_a_winding_loop(spark):
    grid = [(x, y) for x in range(-1, 14) for y in range(-1, 14)]
    pts = [(0, 0), (12, 3), (7, 12), (6, 5), (1, 11)]
    df = spark.createDataFrame(grid, "px bigint, py bigint").crossJoin(polygon(spark, pts))
    got = {(r.px, r.py): r.p for r in df.select("px", "py", geo.position(F.col("ring"), F.col("px"), F.col("py")).alias("p")).collect()}

    def want(px, py):
        inside = False
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if (x2 - x1) * (py - y1) == (px - x1) * (y2 - y1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return 2
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                inside = not inside
        return int(inside)

    assert got == {p: want(*p) for p in grid}


def test_area_centroid_and_rectangle(spark):
    row = polygon(spark, CONCAVE[::-1]).select(
        geo.contour_area(F.col("points")).alias("a"), geo.bounding_rect(F.col("points")).alias("r"),
        geo.centroid(F.col("points"))[0].alias("cx")).first()
    assert row.a == 80 and tuple(row.r) == (0, 0, 13, 13) and row.cx == 4


def test_unknown_contour_test():
    with pytest.raises(NotImplementedError):
        geo.predicate("nope")


def levels(spark):
    return spark.createDataFrame([(1, [(100, 80, 1.0), (25, 20, 4.0)])], "slide_id int, levels array<struct<w: bigint, h: bigint, downsample: double>>")


def contour(spark, pts=SQUARE, idx=0):
    return spark.createDataFrame([(1, idx, pts)], f"slide_id int, cont_idx int, points {POINT}")


def test_tiles_of_a_square(spark):
    tiles = tiling.tile_slides(contour(spark), levels(spark), 4, 4, test="basic")
    assert {(r.x, r.y) for r in tiles.collect()} == {(x, y) for x in (0, 4, 8) for y in (0, 4, 8)}


def test_level_scales_patch_and_step(spark):
    b = tiling.grid_bounds(contour(spark), levels(spark), 4, 2, patch_level=1).first()
    assert (b.step_x, b.ref_patch) == (8, 16)


def test_outside_the_region_of_interest_gives_nothing(spark):
    b = tiling.grid_bounds(contour(spark), levels(spark), 4, 4, top_left=(50, 50), bottom_right=(60, 60))
    assert tiling.tile_grid(b).count() == 0


def test_single_tile_contours_are_dropped(spark):
    both = contour(spark).unionByName(contour(spark, [(50, 50), (51, 50), (51, 51), (50, 51)], 1))
    tiles = tiling.tile_slides(both, levels(spark), 4, 4, test="basic")
    assert {r.cont_idx for r in tiles.collect()} == {0}


def test_centre_on_a_hole_edge_is_kept(spark):
    hole = spark.createDataFrame([(1, 0, 0, [(2, 2), (6, 2), (6, 6), (2, 6)])], f"slide_id int, cont_idx int, hole_idx int, points {POINT}")
    tiles = tiling.tile_slides(contour(spark), levels(spark), 4, 2, test="basic", holes=hole)
    got = {(r.x, r.y) for r in tiles.collect()}
    assert (2, 2) not in got and (0, 0) in got and (4, 0) in got


def test_sliding_windows_stay_inside(spark):
    box = spark.createDataFrame([(0, 0, 10, 10, 100, 100)], "start_0 bigint, start_1 bigint, end_0 bigint, end_1 bigint, h bigint, w bigint")
    got = sorted((r.pos_0, r.pos_1) for r in tiling.sliding_windows(box, ("h", "w"), (4, 4), 0.5).collect())
    assert got == [(a, b) for a in (0, 2, 4, 6) for b in (0, 2, 4, 6)]


def test_tile_boxes_are_those_of_the_kept_tiles(spark):
    from tilewright.plans import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not mounted")
    kept = {(r.slide_id, r.cont_idx, r.x, r.y, r.x + 256, r.y + 256) for r in catalogue.QUERIES["g4b_contour_center"](spark, sf).collect()}
    boxes = catalogue.QUERIES["g13_tile_box"](spark, sf).select("slide_id", "cont_idx", "x_min", "y_min", "x_max", "y_max")
    assert kept and {tuple(r) for r in boxes.collect()} == kept
