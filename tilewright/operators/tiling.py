"""Tile grids inside contours, contour and hole filters, windows and placements.

Contour tests work on scan lines (``scanline``): the edges that span a grid row give the tiles of the row
that pass, as spans of the grid, and only tiles that pass become rows. Holes are cut out of the spans. A
grid that is wanted whole, or for a test of the caller's own, is generated column by column: the strips
are spread over the cluster before their rows are generated, so one large contour does not end up in one
task. The width is explicit: strips are small in bytes, and adaptive execution would otherwise pack them
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

from tilewright.functions import geometry as geo, pyramid as pyr
from tilewright.operators import scanline
from tilewright.operators.ordering import top_rows
from tilewright.session import shuffle_width


def steps(start: Column, stop: Column, step: Column) -> Column:
    """``range(start, stop, step)``; empty when nothing fits."""
    return F.when(stop > start, F.sequence(start, stop - 1, step)).otherwise(F.array().cast("array<bigint>"))


def grid_bounds(
    contours: DataFrame,
    pyramid: DataFrame,
    patch_size: int,
    step_size: int,
    patch_level: int = 0,
    use_padding: bool = True,
    top_left: tuple[int, int] | None = None,
    bottom_right: tuple[int, int] | None = None,
    last_fit: int = 1,
) -> DataFrame:
    """Start, stop and step of the grid of every contour.

    A null contour stands for the whole level. Without padding the grid stops where the last
    whole patch fits; ``last_fit`` 0 gives the older rule that stops one position earlier.
    Contours outside the region of interest drop out.
    """
    levels = F.col("levels")
    level = F.get(levels, F.lit(patch_level))
    base = F.get(levels, F.lit(0))
    scale = F.get(pyr.level_downsamples(levels), F.lit(patch_level))
    whole = F.struct(
        F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), level["w"].alias("w"), level["h"].alias("h"))
    df = contours.join(pyramid.select("slide_id", "levels"), "slide_id").withColumns({
        "__rect": F.when(F.col("points").isNull(), whole).otherwise(geo.bounding_rect(F.col("points"))),
        "__dx": scale["dx"].cast("bigint"), "__dy": scale["dy"].cast("bigint"),
        "__iw": base["w"], "__ih": base["h"],
    })
    ref_x, ref_y = F.col("__dx") * patch_size, F.col("__dy") * patch_size

    def stop(origin: str, extent: str, image: str, ref: Column, axis: int) -> Column:
        end = F.col(f"__rect.{origin}") + F.col(f"__rect.{extent}")
        if not use_padding:
            end = F.least(end, F.col(image) - ref + last_fit)
        return F.least(end, F.lit(bottom_right[axis]).cast("bigint")) if bottom_right else end

    def start(origin: str, axis: int) -> Column:
        at = F.col(f"__rect.{origin}")
        return F.greatest(at, F.lit(top_left[axis]).cast("bigint")) if top_left else at

    out = df.select(
        *contours.columns,
        geo.edges(F.col("points")).alias("ring"),
        start("x", 0).alias("start_x"), stop("x", "w", "__iw", ref_x, 0).alias("stop_x"),
        start("y", 1).alias("start_y"), stop("y", "h", "__ih", ref_y, 1).alias("stop_y"),
        (F.col("__dx") * step_size).alias("step_x"), (F.col("__dy") * step_size).alias("step_y"),
        ref_x.alias("ref_patch"),
    )
    if top_left or bottom_right:
        out = out.filter((F.col("stop_x") > F.col("start_x")) & (F.col("stop_y") > F.col("start_y")))
    return out


def tile_grid(bounds: DataFrame, keys: tuple[str, ...] = ("slide_id", "cont_idx")) -> DataFrame:
    """One row per candidate, with everything ``bounds`` carries but the points."""
    strips = bounds.drop("points").withColumn("x", F.explode(steps(F.col("start_x"), F.col("stop_x"), F.col("step_x"))))
    spread = strips.repartition(shuffle_width(bounds.sparkSession), *keys, "x")
    return spread.withColumn("y", F.explode(steps(F.col("start_y"), F.col("stop_y"), F.col("step_y")))).drop(
        "start_x", "stop_x", "step_x", "start_y", "stop_y", "step_y")


def _marks(low: Column, high: Column, hit: Column | int, cut: Column | int) -> Column:
    """A stretch of grid columns as two marks: what it adds where it begins goes where it ends."""
    def mark(at: Column, sign: int) -> Column:
        return F.struct(
            at.cast("bigint").alias("at"), (sign * F.lit(hit)).cast("int").alias("hit"), (sign * F.lit(cut)).cast("int").alias("cut"))

    return F.inline(F.array(mark(low, 1), mark(high + 1, -1)))


def grid_spans(bounds: DataFrame, test: str | None, holes: DataFrame | None = None) -> DataFrame:
    """Tiles that pass a named contour test, as spans of grid rows; no test keeps the whole grid.

    ``slide_id, cont_idx, line, start, stop`` and the grid: the tiles at ``start_x + step_x * i`` for ``i``
    from ``start`` to ``stop`` in the row at ``start_y + step_y * line``.
    Rows without a contour pass whole. Tiles whose centre lies strictly inside a hole of their contour
    are cut out; the centre may fall between pixels, so holes are tested at twice the size.
    """
    offsets, every = geo.probe_offsets(test, F.col("ref_patch")) if test else (F.array(F.lit(0).cast("bigint")), False)

    def places(axis: str) -> Column:
        span = F.col(f"stop_{axis}") - F.col(f"start_{axis}")
        return F.when(span > 0, scanline.ceil_div(span, F.col(f"step_{axis}"))).otherwise(F.lit(0).cast("bigint"))

    grid = bounds.withColumns({
        "nx": places("x"), "ny": places("y"), "offsets": offsets,
        "need": (F.size(offsets) * F.size(offsets) if every else F.lit(1)).cast("int")})
    keys, carry = ["slide_id", "cont_idx", "line"], ["start_x", "step_x", "nx", "start_y", "step_y", "need"]

    def columns(shift: Column, scale: int) -> tuple[Column, Column]:
        """Grid columns whose probe, ``shift`` from the tile's corner, falls on a run."""
        first, step = F.col("start_x") * scale + shift, F.col("step_x") * scale
        return F.greatest(F.lit(0), scanline.ceil_div(F.col("start") - first, step)), F.least(
            F.col("nx") - 1, scanline.floor_div(F.col("stop") - first, step))

    whole = grid.filter(F.col("points").isNull()) if test else grid
    rows = whole.withColumn("line", F.explode(steps(F.lit(0).cast("bigint"), F.col("ny"), F.lit(1).cast("bigint"))))
    marks = rows.filter("nx > 0").select(*keys, *carry, _marks(F.lit(0), F.col("nx") - 1, F.col("need"), 0))
    if test:
        probed = grid.filter(F.col("points").isNotNull()).withColumn("dy", F.explode("offsets"))
        edges = scanline.edge_table(probed, ["slide_id", "cont_idx", "dy", *carry, "ny", "offsets"])
        crossed = scanline.on_lattice(edges, F.col("start_y") + F.col("dy"), F.col("step_y"), F.col("ny"))
        runs = scanline.covered(crossed, ["slide_id", "cont_idx", "dy", "line"], [*carry, "offsets"])
        low, high = columns(F.col("dx"), 1)
        hits = runs.withColumn("dx", F.explode("offsets")).withColumns({"low": low, "high": high}).filter("low <= high")
        marks = marks.unionByName(hits.select(*keys, *carry, _marks(F.col("low"), F.col("high"), 1, 0)))
    if holes is not None:
        # A hole given twice cuts once; as one polygon its edges would cancel.
        doubled = holes.select("slide_id", "cont_idx", geo.scale_points(F.col("points"), F.lit(2), F.lit(2)).alias("points"))
        named = doubled.withColumn("hole", F.xxhash64("points")).dropDuplicates(["slide_id", "cont_idx", "hole"])
        placed = named.join(grid.select("slide_id", "cont_idx", *carry, "ny", "ref_patch"), ["slide_id", "cont_idx"])
        edges = scanline.edge_table(placed, ["slide_id", "cont_idx", "hole", *carry, "ny", "ref_patch"])
        crossed = scanline.on_lattice(edges, F.col("start_y") * 2 + F.col("ref_patch"), F.col("step_y") * 2, F.col("ny"))
        runs = scanline.covered(crossed, ["slide_id", "cont_idx", "hole", "line"], [*carry, "ref_patch"], strict=True)
        low, high = columns(F.col("ref_patch"), 2)
        cuts = runs.withColumns({"low": low, "high": high}).filter("low <= high")
        marks = marks.unionByName(cuts.select(*keys, *carry, _marks(F.col("low"), F.col("high"), 0, 1)))
    passes = (F.col("hit") >= F.col("need")) & (F.col("cut") == 0)
    return scanline.stretches(marks, keys, ["hit", "cut"], passes, carry).drop("need")


def span_tiles(spans: DataFrame) -> DataFrame:
    """``slide_id, cont_idx, x, y`` of every tile of the spans."""
    return spans.select(
        "slide_id", "cont_idx", "start_x", "step_x", (F.col("start_y") + F.col("line") * F.col("step_y")).alias("y"),
        F.explode(F.sequence("start", "stop")).alias("i"),
    ).select("slide_id", "cont_idx", (F.col("start_x") + F.col("i") * F.col("step_x")).alias("x"), "y")


def drop_sparse_spans(spans: DataFrame) -> DataFrame:
    """Contours with a single tile lose it. A contour has a few spans per grid row, so a plain window is enough."""
    tiles = F.sum(F.col("stop") - F.col("start") + 1).over(W.partitionBy("slide_id", "cont_idx"))
    return spans.withColumn("__n", tiles).filter(F.col("__n") > 1).drop("__n")


def in_contour(candidates: DataFrame, test: geo.Predicate) -> DataFrame:
    """Candidates that pass a test of the caller's own; rows without a contour pass.

    The ring rides in every candidate here, since the test is handed it; named tests go by ``grid_spans``.
    """
    ok = geo.predicate(test)(F.col("ring"), F.col("x"), F.col("y"), F.col("ref_patch"))
    return candidates.filter(F.col("ring").isNull() | ok)


def outside_holes(candidates: DataFrame, bounds: DataFrame, holes: DataFrame) -> DataFrame:
    """Candidates on the grid of ``bounds`` whose centre does not lie strictly inside a hole of their contour."""
    open_ = grid_spans(bounds, None, holes).select(
        "slide_id", "cont_idx", (F.col("start_y") + F.col("line") * F.col("step_y")).alias("y"),
        (F.col("start_x") + F.col("start") * F.col("step_x")).alias("__from"),
        (F.col("start_x") + F.col("stop") * F.col("step_x")).alias("__to"))
    return candidates.join(open_, ["slide_id", "cont_idx", "y"]).filter(F.col("x").between(F.col("__from"), F.col("__to"))).select(
        *candidates.columns)


def drop_sparse(tiles: DataFrame, keys: tuple[str, ...] = ("slide_id", "cont_idx")) -> DataFrame:
    """Contours with a single tile lose it."""
    full = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return tiles.join(full.select(*keys), list(keys), "left_semi")


def tile_slides(
    contours: DataFrame,
    pyramid: DataFrame,
    patch_size: int,
    step_size: int,
    patch_level: int = 0,
    test: str | geo.Predicate = "four_pt",
    holes: DataFrame | None = None,
    **bounds: object,
) -> DataFrame:
    """``slide_id, cont_idx, x, y`` of every kept tile. Holes are only tested when they are given."""
    limits = grid_bounds(contours, pyramid, patch_size, step_size, patch_level, **bounds)
    if not callable(test):
        return span_tiles(drop_sparse_spans(grid_spans(limits, test, holes)))
    kept = in_contour(tile_grid(limits), test)
    if holes is not None:
        kept = outside_holes(kept, limits, holes)
    return drop_sparse(kept.select("slide_id", "cont_idx", "x", "y"))


def tile_sets(pyramid: DataFrame, patch_size: int, patch_level: int, save_path: str) -> DataFrame:
    """One attribute row per slide."""
    level = F.get(F.col("levels"), F.lit(patch_level))
    scale = F.get(pyr.level_downsamples(F.col("levels")), F.lit(patch_level))
    dims = F.array(level["w"], level["h"])
    return pyramid.select(
        "slide_id", F.lit(patch_size).alias("patch_size"), F.lit(patch_level).alias("patch_level"),
        F.array(scale["dx"], scale["dy"]).alias("downsample"), dims.alias("downsampled_level_dim"),
        dims.alias("level_dim"), F.lit(save_path).alias("save_path"),
    )


def filter_contours(contours: DataFrame, holes: DataFrame, min_area: Column | float) -> DataFrame:
    """Keep contours whose area without their holes is non-zero and above ``min_area``."""
    hole_area = holes.groupBy("slide_id", "cont_idx").agg(F.sum(geo.contour_area(F.col("points"))).alias("__holes"))
    joined = contours.join(hole_area, ["slide_id", "cont_idx"], "left").withColumn(
        "net_area", geo.contour_area(F.col("points")) - F.coalesce(F.col("__holes"), F.lit(0.0)))
    return joined.filter((F.col("net_area") != 0) & (F.col("net_area") > min_area)).drop("__holes")


def top_holes(holes: DataFrame, max_holes: int, min_area: Column | float) -> DataFrame:
    """The largest holes of each contour, then only those above ``min_area``."""
    sized = holes.withColumn("area", geo.contour_area(F.col("points")))
    best = top_rows(sized, ["slide_id", "cont_idx"], [F.col("area").desc(), F.col("hole_idx")], max_holes)
    return best.filter(F.col("area") > min_area)


def tile_box(tiles: DataFrame, patch: Column, downsample: Column | int = 1) -> DataFrame:
    """Corner to box. The far corner adds the unscaled patch size unless a downsample is given."""
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    size = (patch * downsample).cast("bigint")
    rest = [c for c in tiles.columns if c not in ("x", "y")]
    return tiles.select(
        x.alias("x_min"), y.alias("y_min"), (x + size).alias("x_max"), (y + size).alias("y_max"), *rest)


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint")


def sliding_windows(
    boxes: DataFrame,
    image: tuple[str, str],
    patch: tuple[float | None, float | None],
    overlap: float | int = 0.0,
    padded: bool = False,
    box: tuple[str, str, str, str] = ("start_0", "start_1", "end_0", "end_1"),
) -> DataFrame:
    """Window corners ``pos_0, pos_1`` over each box; a fractional overlap is relative to the patch."""
    df = boxes
    for axis in (0, 1):
        size = F.col(image[axis]).cast("double")
        p = F.least(size, F.lit(float(patch[axis]))) if patch[axis] else size
        step = half_even(p * (1.0 - overlap)) if isinstance(overlap, float) else (p - overlap).cast("bigint")
        end = F.col(box[2 + axis])
        stop = end if padded else end - half_even(p) + 1
        df = df.withColumn(f"pos_{axis}", F.explode(steps(
            F.col(box[axis]).cast("bigint"), stop.cast("bigint"), step)))
    return df


def scale_boxes(boxes: DataFrame, factor_0: Column, factor_1: Column) -> DataFrame:
    """Mask boxes ``min_row, min_col, max_row, max_col`` to a level, truncated."""
    return boxes.withColumns({
        "start_0": (F.col("min_row") * factor_0).cast("bigint"), "start_1": (F.col("min_col") * factor_1).cast("bigint"),
        "end_0": (F.col("max_row") * factor_0).cast("bigint"), "end_1": (F.col("max_col") * factor_1).cast("bigint"),
    })


def mask_patch(location: Column, ratio: float, size: float) -> Column:
    """Level-0 corner of the patch centred on a mask pixel."""
    return half_even((location + 0.5) * ratio - F.floor(F.lit(size) / 2))


def window_to_mask(position: Column, ratio: float, size: float) -> Column:
    return half_even((position + F.floor(F.lit(size) / 2)) / ratio)


def probe_rows(tiles: DataFrame, mode: str, keys: list[str], scale: int) -> DataFrame:
    """What each mode tests: rows ``slide_id, keys, corner, row, left, right``, two points in each.

    ``center`` and ``basic`` test one point; ``any`` and ``all`` the four corners, in two rows.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("x_min", "y_min", "x_max", "y_max"))
    probes = {
        "center": [((x0 + x1) / 2, (x0 + x1) / 2, (y0 + y1) / 2)], "basic": [(x0, x0, y0)],
        "any": [(x0, x1, y0), (x0, x1, y1)], "all": [(x0, x1, y0), (x0, x1, y1)],
    }
    if mode not in probes:
        raise ValueError(f"mode must be one of {sorted(probes)}")
    whole = lambda v: F.round(v * scale).cast("bigint")
    rows = F.array(*[F.struct(whole(y).alias("row"), whole(a).alias("left"), whole(b).alias("right")) for a, b, y in probes[mode]])
    return tiles.select("slide_id", *keys, F.posexplode(rows).alias("corner", "p")).select("slide_id", *keys, "corner", "p.*")


def filter_tiles(tiles: DataFrame, polygons: DataFrame, mode: str = "center", keys: list[str] | None = None) -> DataFrame:
    """Tiles whose tested points lie strictly inside the polygons of their slide.

    The rows that hold points are cut through the polygons once, into runs; a point then meets the runs
    of its row. Whole coordinates are tested at twice the size, so half pixels are exact; fractions are
    taken to a 1024th of a pixel. A polygon given twice counts once. Runs and points grow with the tiles and
    meet by merging: none of them is broadcast.
    """
    keys = keys or ["tile_id"]
    pair = polygons.schema["points"].dataType.elementType
    scale = 2 if all(isinstance(f.dataType, IntegralType) for f in pair) else 1024
    points = probe_rows(tiles, mode, keys, scale)
    scaled = F.transform("points", lambda p: F.struct(
        F.round(p["x"] * scale).cast("bigint").alias("x"), F.round(p["y"] * scale).cast("bigint").alias("y")))
    named = polygons.select("slide_id", scaled.alias("points")).withColumn("ring", F.xxhash64("points"))
    edges = scanline.edge_table(named.dropDuplicates(["slide_id", "ring"]), ["slide_id", "ring"])
    crossed = scanline.at_rows(edges, points.select("slide_id", "row").distinct(), ["slide_id"], scanline.BAND * scale)
    runs = scanline.joined(scanline.covered(crossed, ["slide_id", "ring", "row"], strict=True), ["slide_id", "row"])
    runs = runs.withColumnsRenamed({"slide_id": "__s", "row": "__row"})
    left, right = (F.col(c).between(F.col("start"), F.col("stop")) for c in ("left", "right"))
    met = (F.col("slide_id") == F.col("__s")) & (F.col("row") == F.col("__row")) & (left | right)
    if mode != "all":
        inside = points.join(runs.hint("merge"), met, "left_semi")
    else:
        bits = F.when(left, 1).otherwise(0) + F.when(right, 2).otherwise(0)
        found = points.join(runs.hint("merge"), met).groupBy("slide_id", *keys).agg(
            F.bit_or(F.call_function("shiftleft", bits, 2 * F.col("corner"))).alias("__bits"))
        inside = found.filter(F.col("__bits") == 15)
    return tiles.join(inside.select("slide_id", *keys).hint("merge"), ["slide_id", *keys], "left_semi")


def coord_product(df: DataFrame, x: tuple[Column, Column, Column], y: tuple[Column, Column, Column]) -> DataFrame:
    """All (x, y) of two ranges, with every column of ``df`` carried along."""
    return df.withColumn("x", F.explode(steps(*x))).withColumn("y", F.explode(steps(*y)))


def placement(
    tiles: DataFrame, patch: Column, downsample: Column, canvas_w: Column, canvas_h: Column
) -> DataFrame:
    """Where a tile lands on a downsampled canvas, and how much of it fits."""
    px = F.ceil(F.col("x") / downsample).cast("bigint")
    py = F.ceil(F.col("y") / downsample).cast("bigint")
    size = F.ceil(patch / downsample).cast("bigint")

    def fitting(at: Column, canvas: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(size, canvas - at))

    return tiles.withColumns({
        "place_x": px, "place_y": py, "place_w": fitting(px, canvas_w), "place_h": fitting(py, canvas_h)})


def mosaic_cell(index: Column, patch: int = 256, downscale: int = 4, per_row: int = 10) -> tuple[Column, Column]:
    """Pixel corner of the ``index``-th patch (zero-based) on a mosaic."""
    cell = -(-patch // downscale)
    return (index % per_row) * cell, F.floor(index / per_row).cast("bigint") * cell


def patch_level_coordinate(value: Column, downsample: Column) -> Column:
    return F.floor(value / downsample).cast("bigint")


def random_offset(key: Column, low: Column, high: Column, seed: int, axis: int) -> Column:
    """A repeatable offset in ``[low, high)`` drawn from the md5 of seed, axis and key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(axis)), key.cast("string")))
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return low + drawn % (high - low)


def raster(contours: DataFrame, holes: DataFrame | None = None) -> DataFrame:
    """The mask as runs: contours are filled from the largest on, each then loses its holes.

    ``slide_id, row, start, stop``, disjoint; runs may touch.
    """
    ranked = geo.sort_by_area(contours, ["slide_id"])
    fills = ranked.select(
        "slide_id", (F.col("cont_rank") * 2).alias("seq"), F.lit(0).cast("bigint").alias("part"), "points")
    if holes is not None:
        cut = holes.join(ranked.select("slide_id", "cont_idx", "cont_rank"), ["slide_id", "cont_idx"])
        fills = fills.unionByName(cut.select(
            "slide_id", (F.col("cont_rank") * 2 + 1).alias("seq"), F.col("hole_idx").alias("part"), "points"))
    runs = scanline.fill(fills, ["slide_id", "seq", "part"])
    # The last step that touches a pixel decides: even steps fill, odd steps clear.
    last = scanline.topmost(runs.drop("part"), ["slide_id", "row"], "seq")
    return last.filter(F.col("seq") % 2 == 0).select("slide_id", "row", "start", "stop")


def tissue_fraction(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of the region that is tissue, zero where nothing was found; ``mask`` holds disjoint runs."""
    counted = mask.groupBy("slide_id").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("pixels"))
    return sizes.join(counted, "slide_id", "left").select(
        "slide_id", F.coalesce(F.col("pixels"), F.lit(0)).alias("pixels"),
        (F.coalesce(F.col("pixels"), F.lit(0)) / (F.col("width") * F.col("height"))).alias("fraction"))
