"""Polygons by scan lines against loops over points, with rings of hundreds to thousands of vertices."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import scanline, tiling

POINT = "array<struct<x: bigint, y: bigint>>"


def star(seed: int, n: int, size: int) -> list[tuple[int, int]]:
    """A jagged ring with flat edges, repeated points and spikes along its way."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        r = size * (0.35 + 0.6 * rnd.random())
        a = 2 * math.pi * i / n
        out.append((round(size + r * math.cos(a)), round(size + r * math.sin(a))))
        if i % 9 == 0:
            out.append((out[-1][0] + 3, out[-1][1]))
        if i % 17 == 0:
            out.append(out[-1])
    return out


def where(ring, px, py) -> int:
    """2 on an edge, 1 inside, 0 outside."""
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (x2 - x1) * (py - y1) == (px - x1) * (y2 - y1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return 2
        if (y1 > py) != (y2 > py):
            turn = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            inside ^= turn > 0 if y2 > y1 else turn < 0
    return int(inside)


def polygons(spark, rings):
    return spark.createDataFrame([(1, i, r) for i, r in enumerate(rings)], f"slide_id int, cont_idx bigint, points {POINT}")


def test_filled_pixels(spark):
    rings = [star(1, 60, 20), star(2, 7, 15), [(3, 3), (3, 3), (3, 3)], [(0, 5), (9, 5), (4, 5)], [(0, 0), (12, 3), (7, 12), (6, 5), (1, 11)]]
    got = {}
    for r in scanline.fill(polygons(spark, rings), ["cont_idx"]).collect():
        for c in range(r.start, r.stop + 1):
            assert (r.row, c) not in got.setdefault(r.cont_idx, set())
            got[r.cont_idx].add((r.row, c))
    for i, ring in enumerate(rings):
        box = [(y, x) for y in range(-2, 50) for x in range(-2, 50)]
        assert got[i] == {p for p in box if where(ring, p[1], p[0])}


def test_raster_takes_the_last_step(spark):
    rings = [star(3, 40, 24), star(4, 30, 12)]
    hole = spark.createDataFrame([(1, 0, 0, [(20, 18), (30, 18), (28, 30)]), (1, 1, 0, [(10, 8), (14, 9), (12, 15)])],
                                 f"slide_id int, cont_idx bigint, hole_idx bigint, points {POINT}")
    mask = tiling.raster(polygons(spark, rings), hole).collect()
    got = {(r.row, c) for r in mask for c in range(r.start, r.stop + 1)}
    assert len(got) == sum(r.stop - r.start + 1 for r in mask)
    steps = [rings[0], [(20, 18), (30, 18), (28, 30)], rings[1], [(10, 8), (14, 9), (12, 15)]]  # the larger contour first
    want = set()
    for y in range(-1, 60):
        for x in range(-1, 60):
            hit = [i for i, r in enumerate(steps) if where(r, x, y)]
            if hit and hit[-1] % 2 == 0:
                want.add((y, x))
    assert got == want


@pytest.mark.parametrize("test,shifts,every", [
    ("basic", [(0, 0)], False), ("center", [(8, 8)], False),
    ("four_pt", [(4, 4), (12, 4), (4, 12), (12, 12)], False), ("four_pt_hard", [(4, 4), (12, 4), (4, 12), (12, 12)], True)])
def test_tiles_of_large_rings(spark, test, shifts, every):
    rings = [star(5, 3000, 160), star(6, 500, 120)]
    holes = [(1, 0, 0, star(7, 300, 40)), (1, 0, 0, star(7, 300, 40)), (1, 1, 0, [(80, 80), (140, 90), (100, 150)])]
    pyramid = spark.createDataFrame([(1, [(400, 400, 1.0)])], "slide_id int, levels array<struct<w: bigint, h: bigint, downsample: double>>")
    cut = spark.createDataFrame(holes, f"slide_id int, cont_idx bigint, hole_idx bigint, points {POINT}")
    contours = polygons(spark, rings)
    got = {(r.cont_idx, r.x, r.y) for r in tiling.tile_slides(contours, pyramid, 16, 7, test=test, holes=cut).collect()}
    want = set()
    for i, ring in enumerate(rings):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        mine = [[(2 * a, 2 * b) for a, b in h[3]] for h in holes if h[1] == i]
        for x in range(min(xs), max(xs) + 1, 7):
            for y in range(min(ys), max(ys) + 1, 7):
                hits = [where(ring, x + a, y + b) > 0 for a, b in shifts]
                if (all(hits) if every else any(hits)) and not any(where(h, 2 * x + 16, 2 * y + 16) == 1 for h in mine):
                    want.add((i, x, y))
    assert got == want


def test_candidates_carry_no_ring(spark):
    pyramid = spark.createDataFrame([(1, [(400, 400, 1.0)])], "slide_id int, levels array<struct<w: bigint, h: bigint, downsample: double>>")
    limits = tiling.grid_bounds(polygons(spark, [star(5, 50, 90)]), pyramid, 16, 7)
    assert "ring" not in tiling.grid_spans(limits, "four_pt").columns
    own = tiling.tile_slides(polygons(spark, [star(5, 50, 90)]), pyramid, 16, 7, test=lambda ring, x, y, patch: x > y)
    assert own.filter("x <= y").count() == 0 and own.count() > 0


@pytest.mark.parametrize("mode", ["center", "basic", "any", "all"])
def test_points_in_polygons(spark, mode):
    rings = [star(8, 2000, 150), star(9, 40, 60)]
    rnd = random.Random(1)
    boxes = [(1 if i % 5 else 2, i, x := rnd.randrange(-5, 300), y := rnd.randrange(-5, 300), x + rnd.randrange(1, 30), y + rnd.randrange(1, 30)) for i in range(400)]
    tiles = spark.createDataFrame(boxes, "slide_id int, tile_id int, x_min bigint, y_min bigint, x_max bigint, y_max bigint")
    halves = polygons(spark, rings).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] * 1.0).alias("y"))))
    for shapes, scale, shift in ((polygons(spark, [*rings, rings[0]]), 2, 0), (halves, 2, 1)):
        doubled = [[(2 * a + shift, 2 * b) for a, b in r] for r in rings]
        got = {r.tile_id for r in tiling.filter_tiles(tiles, shapes.drop("cont_idx"), mode).collect()}
        want = set()
        for s, i, x0, y0, x1, y1 in boxes:
            points = {"center": [(x0 + x1, y0 + y1)], "basic": [(2 * x0, 2 * y0)]}.get(mode) or [(2 * a, 2 * b) for a in (x0, x1) for b in (y0, y1)]
            hits = [any(where(r, *p) == 1 for r in doubled) for p in points]
            if s == 1 and (all(hits) if mode == "all" else any(hits)):
                want.add(i)
        assert got == want


@pytest.mark.parametrize("mode", ["center", "all"])
def test_point_filters_broadcast_nothing(spark, mode):
    """Tables that are planned as small, as those a small table is exploded to, stay off the driver."""
    at = F.col("id") * 10
    tiles = spark.range(4).select(
        F.lit(1).alias("slide_id"), F.col("id").alias("tile_id"), at.alias("x_min"), at.alias("y_min"), (at + 4).alias("x_max"), (at + 4).alias("y_max"))
    corner = lambda x, y: F.struct(F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y"))
    square = spark.range(1).select(F.lit(1).alias("slide_id"), F.array(corner(5, 5), corner(28, 5), corner(28, 28), corner(5, 28)).alias("points"))
    kept = tiling.filter_tiles(tiles, square, mode)
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.tile_id for r in kept.collect()) == [1, 2]
