from __future__ import annotations

import random

from pyspark.sql import functions as F

from tilewright.operators import regions, runs
from tilewright.operators.components import connected_components


def mask_frame(spark, images):
    rows = [(s, r, c) for s, cells in images.items() for r, c in cells]
    return spark.createDataFrame(rows, "slide_id bigint, row bigint, col bigint")


def flood(cells, steps):
    left, out = set(cells), {}
    while left:
        start = min(left)
        stack, group = [start], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.discard(p)
                group.add(p)
                stack += [(p[0] + a, p[1] + b) for a, b in steps]
        for p in group:
            out[p] = start
    return out


EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def images(seed, h=18, w=20, density=0.42, n=3):
    rng = random.Random(seed)
    return {s: {(r, c) for r in range(h) for c in range(w) if rng.random() < density} for s in range(n)}


def sizes(spark, n=3, h=18, w=20):
    return spark.createDataFrame([(s, w, h) for s in range(n)], "slide_id bigint, width bigint, height bigint")


def pixels_of(df):
    return {(r.slide_id, r.row, r.col) for r in df.collect()}


def test_labels_match_a_flood_fill(spark):
    data = images(5)
    got = {}
    for r in runs.to_pixels(runs.label_runs(runs.from_pixels(mask_frame(spark, data))), ["region"]).collect():
        got.setdefault((r.slide_id, r.region), set()).add((r.row, r.col))
    want = {}
    for s, cells in data.items():
        for p, first in flood(cells, EIGHT).items():
            want.setdefault((s, first), set()).add(p)
    assert {(s, frozenset(v)) for (s, _), v in got.items()} == {(s, frozenset(v)) for (s, _), v in want.items()}


def test_holes_match_a_flood_from_the_border(spark):
    data = images(9, density=0.6)
    got = pixels_of(runs.to_pixels(runs.fill_holes(runs.from_pixels(mask_frame(spark, data)), sizes(spark))))
    want = set()
    for s, cells in data.items():
        empty = {(r, c) for r in range(18) for c in range(20)} - cells
        groups = flood(empty, FOUR)
        open_air = {g for (r, c), g in groups.items() if r in (0, 17) or c in (0, 19)}
        want |= {(s, *p) for p in cells} | {(s, *p) for p, g in groups.items() if g not in open_air}
    assert got == want


def test_erosion_and_dilation_match_loops(spark):
    data = images(3, density=0.8)
    lines = runs.from_pixels(mask_frame(spark, data))
    offsets = [(d, x) for d, h in runs.ELLIPSE_5.items() for x in range(-h, h + 1)]

    def inside(r, c):
        return 0 <= r < 18 and 0 <= c < 20

    eroded = {(s, r, c) for s, cells in data.items() for r, c in cells
              if all((r + a, c + b) in cells for a, b in offsets if inside(r + a, c + b))}
    grown = {(s, r + a, c + b) for s, cells in data.items() for r, c in cells for a, b in offsets if inside(r + a, c + b)}
    assert pixels_of(runs.to_pixels(runs.erode(lines, sizes(spark), runs.ELLIPSE_5))) == eroded
    assert pixels_of(runs.to_pixels(runs.dilate(lines, sizes(spark), runs.ELLIPSE_5))) == grown


def test_long_chain_settles(spark):
    nodes = spark.range(400).select(F.lit(1).alias("k"), "id")
    chain = lambda n: n.filter("id < 399").select("k", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = connected_components(nodes, chain, ["k"])
    assert out.select("component").distinct().collect() == [(0,)]
    assert out.count() == 400


def test_clusters_match_single_linkage(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.randint(1, 30), rng.uniform(0, 120), rng.uniform(0, 120)) for s in (1, 2) for i in range(40)]
    # Crowd one cell so that its members are linked without being compared.
    rows += [(1, 100 + i, 5, 50 + i * 0.01, 50.0) for i in range(30)]
    df = spark.createDataFrame(rows, "slide_id int, region bigint, area bigint, centroid_row double, centroid_col double")
    got = {(r.slide_id, r.region): r.cluster for r in regions.cluster_regions(df, 12.0).collect()}
    for s in (1, 2):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))
        label, n = {}, 0
        for r in mine:
            if r[1] in label:
                continue
            stack = [r]
            while stack:
                a = stack.pop()
                if a[1] in label:
                    continue
                label[a[1]] = n
                stack += [b for b in mine if b[1] not in label and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 144]
            n += 1
        assert {k: got[(s, k)] for k in label} == label


def test_tiles_in_mask_are_those_with_their_centre_on_it(spark):
    from tilewright.plans import workflows

    inside = {(r, c) for r in range(2, 9) for c in range(1, 12) if (r + c) % 7}
    pixels = spark.createDataFrame([(1, r, c) for r, c in inside], "slide_id int, row bigint, col bigint")
    boxes = spark.createDataFrame([(1, 0, 1, 2, 11, 8)], "slide_id int, cluster int, x_min int, y_min int, x_max int, y_max int")
    got = {(r.x, r.y) for r in workflows.tiles_in_mask(runs.from_pixels(pixels), boxes, 10, 5, 4.0).collect()}
    grid = {(x, y) for x in range(4, 48, 5) for y in range(8, 36, 5)}
    assert got == {(x, y) for x, y in grid if (int((y + 5) // 4), int((x + 5) // 4)) in inside}
