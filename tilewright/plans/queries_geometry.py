"""Catalogue entries: tile geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright.functions import geometry as geo
from tilewright.operators import tiling
from tilewright.plans import proxies
from tilewright.plans.proxy_sql import sql
from tilewright.plans.registry import Registry
from tilewright.sources import annotations

query = Registry()

PATCH, STEP = 256, 200


def pip(points: str, edges: str, on: str, keys: str) -> str:
    """Per key: does the point lie on an edge, and does a ray cross an odd number of edges."""
    return f"""
select {keys}, bool_or(cross_zero and px between least(x1,x2) and greatest(x1,x2) and py between least(y1,y2) and greatest(y1,y2)) as on_edge,
  count(*) filter (where (y1 > py) <> (y2 > py) and px < (x2-x1)*(py-y1)::double/nullif(y2-y1, 0) + x1) % 2 = 1 as odd
from (select *, (x2-x1)*(py-y1) = (px-x1)*(y2-y1) as cross_zero from {points} join {edges} using ({on})) group by {keys}"""


BBOX = "select slide_id, cont_idx, min(x) as bx, min(y) as oy, max(x)-min(x)+1 as bw, max(y)-min(y)+1 as bh from cont group by all"
CANDIDATES = f"""
select slide_id, cont_idx, x, y from bbox, lateral (select unnest(range(bx, bx+bw, {STEP})) as x), lateral (select unnest(range(oy, oy+bh, {STEP})) as y)"""
BASE = {"bbox": BBOX, "cand": CANDIDATES}


def bounds(spark: SparkSession, sf: str, **kw: object) -> DataFrame:
    return tiling.grid_bounds(proxies.contours(spark, sf), proxies.pyramid(spark, sf), PATCH, STEP, 0, **kw)


@query("g1_tile_grid", sql(f"""
select slide_id, cont_idx, x, y from cand
union all select slide_id, 9, x, y from levels, lateral (select unnest(range(0, w, {STEP})) as x), lateral (select unnest(range(0, h, {STEP})) as y)
where slide_id % 10 = 9 and level = 0""", "cont", "levels", extra=BASE))
def g1(spark: SparkSession, sf: str) -> DataFrame:
    whole = proxies.slides(spark, sf).filter(F.col("slide_id") % 10 == 9).select(
        "slide_id", F.lit(9).cast("bigint").alias("cont_idx"))
    both = proxies.contours(spark, sf).unionByName(whole, allowMissingColumns=True)
    grid = tiling.tile_grid(tiling.grid_bounds(both, proxies.pyramid(spark, sf), PATCH, STEP))
    return grid.select("slide_id", "cont_idx", "x", "y")


@query("g2_padding_rule", sql("""
select slide_id, cont_idx, least(bx+bw, w - 10000 + 1) as stop_x, least(oy+bh, h - 10000 + 1) as stop_y,
  least(bx+bw, w - 10000) as older_x, bx+bw as padded_x
from bbox join levels using (slide_id) where level = 0""", "cont", "levels", extra=BASE))
def g2(spark: SparkSession, sf: str) -> DataFrame:
    def variant(**kw: object) -> DataFrame:
        return tiling.grid_bounds(proxies.contours(spark, sf), proxies.pyramid(spark, sf), 10000, STEP, 0, **kw)

    keys = ["slide_id", "cont_idx"]
    exact = variant(use_padding=False).select(*keys, "stop_x", "stop_y")
    older = variant(use_padding=False, last_fit=0).select(*keys, F.col("stop_x").alias("older_x"))
    padded = variant().select(*keys, F.col("stop_x").alias("padded_x"))
    return exact.join(older, keys).join(padded, keys)


@query("g3_roi_clamp", sql("""
select slide_id, cont_idx, greatest(bx, 1500) as start_x, greatest(oy, 1200) as start_y, least(bx+bw, 5200) as stop_x, least(oy+bh, 4000) as stop_y
from bbox where least(bx+bw, 5200) > greatest(bx, 1500) and least(oy+bh, 4000) > greatest(oy, 1200)""", "cont", extra=BASE))
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return bounds(spark, sf, top_left=(1500, 1200), bottom_right=(5200, 4000)).select(
        "slide_id", "cont_idx", "start_x", "start_y", "stop_x", "stop_y")


SHIFTS = {
    "basic": "(0,0)",
    "center": f"({PATCH // 2},{PATCH // 2})",
    "four_pt": f"({PATCH // 4},{PATCH // 4}),({3 * PATCH // 4},{PATCH // 4}),({PATCH // 4},{3 * PATCH // 4}),({3 * PATCH // 4},{3 * PATCH // 4})",
}
SHIFTS["four_pt_hard"] = SHIFTS["four_pt"]


def tested(mode: str) -> dict[str, str]:
    every = "bool_and" if mode == "four_pt_hard" else "bool_or"
    return {
        **BASE,
        "probe": f"select slide_id, cont_idx, x, y, x + dx as px, y + dy as py from cand, (values {SHIFTS[mode]}) s(dx, dy)",
        "hit": pip("probe", "edges", "slide_id, cont_idx", "slide_id, cont_idx, x, y, px, py"),
        "kept": f"select slide_id, cont_idx, x, y from hit group by all having {every}(odd or on_edge)",
    }


def _contour_test(name: str, mode: str):
    @query(name, sql("select * from kept", "edges", extra=tested(mode)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return tiling.span_tiles(tiling.grid_spans(bounds(spark, sf), mode))

    return run


g4a = _contour_test("g4a_contour_basic", "basic")
g4b = _contour_test("g4b_contour_center", "center")
g4c = _contour_test("g4c_contour_four_pt", "four_pt")
g4d = _contour_test("g4d_contour_four_pt_hard", "four_pt_hard")


@query("u3_custom_predicate", sql("""
select slide_id, cont_idx, x, y from hit group by all having count(*) filter (where odd or on_edge) >= 3""", "edges", extra=tested("four_pt")))
def u3(spark: SparkSession, sf: str) -> DataFrame:
    def most_points(ring, x, y, patch):
        s = F.floor(patch / 4).cast("bigint")
        hits = [geo.inside_or_edge(ring, x + a * s, y + b * s).cast("int") for a in (1, 3) for b in (1, 3)]
        return sum(hits[1:], hits[0]) >= 3

    return tiling.in_contour(tiling.tile_grid(bounds(spark, sf)), most_points).select("slide_id", "cont_idx", "x", "y")


HOLE_TEST = {
    **tested("center"),
    "hprobe": f"select slide_id, cont_idx, hole_idx, x, y, 2*x + {PATCH} as px, 2*y + {PATCH} as py from kept join (select distinct slide_id, cont_idx, hole_idx from hole) using (slide_id, cont_idx)",
    "hedges2": "select slide_id, cont_idx, hole_idx, 2*x1 as x1, 2*y1 as y1, 2*x2 as x2, 2*y2 as y2 from hole_edges",
    "hhit": pip("hprobe", "hedges2", "slide_id, cont_idx, hole_idx", "slide_id, cont_idx, hole_idx, x, y, px, py"),
    "outside": "select k.* from kept k anti join (select * from hhit where odd and not on_edge) h using (slide_id, cont_idx, x, y)",
}


@query("g5_hole_exclusion", sql("select * from outside", "edges", "hole_edges", extra=HOLE_TEST))
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.span_tiles(tiling.grid_spans(bounds(spark, sf), "center", proxies.holes(spark, sf)))


@query("g6_drop_sparse", sql("""
select slide_id, cont_idx, x, y from (select *, count(*) over (partition by slide_id, cont_idx) as n from (
  select slide_id, cont_idx, x, y from bbox, lateral (select unnest(range(bx, bx+bw, 2500)) as x), lateral (select unnest(range(oy, oy+bh, 2500)) as y))) where n > 1""", "cont", extra=BASE))
def g6(spark: SparkSession, sf: str) -> DataFrame:
    coarse = tiling.grid_bounds(proxies.contours(spark, sf), proxies.pyramid(spark, sf), PATCH, 2500)
    return tiling.span_tiles(tiling.drop_sparse_spans(tiling.grid_spans(coarse, None)))


AREAS = "select slide_id, cont_idx, abs(sum(x1*y2 - x2*y1)) / 2.0::double as area from edges group by all"
HOLE_AREAS = "select slide_id, cont_idx, hole_idx, abs(sum(x1*y2 - x2*y1)) / 2.0::double as area from hole_edges group by all"


@query("g7_contour_area", sql("""
select slide_id, cont_idx, area, row_number() over (partition by slide_id order by area desc) - 1 as cont_rank from areas""", "edges", extra={"areas": AREAS}))
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return geo.sort_by_area(proxies.contours(spark, sf), ["slide_id"]).select("slide_id", "cont_idx", "area", "cont_rank")


@query("g8_bounding_rect", sql("select slide_id, cont_idx, bx as x, oy as y, bw as w, bh as h from bbox", "cont", extra=BASE))
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.contours(spark, sf).select("slide_id", "cont_idx", geo.bounding_rect(F.col("points")).alias("r")).select(
        "slide_id", "cont_idx", "r.x", "r.y", "r.w", "r.h")


@query("g9_filter_contours", sql("""
select slide_id, cont_idx, net_area from (select a.slide_id, a.cont_idx, a.area - coalesce(h.area, 0) as net_area from areas a
  left join (select slide_id, cont_idx, sum(area) as area from hareas group by all) h using (slide_id, cont_idx)) where net_area <> 0 and net_area > 2600000""",
    "edges", "hole_edges", extra={"areas": AREAS, "hareas": HOLE_AREAS}))
def g9(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.filter_contours(proxies.contours(spark, sf), proxies.holes(spark, sf), 2_600_000).select(
        "slide_id", "cont_idx", "net_area")


@query("g10_top_holes", sql("""
select slide_id, cont_idx, hole_idx, area from (select *, row_number() over (partition by slide_id, cont_idx order by area desc, hole_idx) as rn from hareas)
where rn <= 2 and area > 60000""", "hole_edges", extra={"hareas": HOLE_AREAS}))
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.top_holes(proxies.holes(spark, sf), 2, 60_000).select("slide_id", "cont_idx", "hole_idx", "area")


@query("g11_scale_contours", sql("select slide_id, cont_idx, k, trunc(x*0.03::double)::bigint as x, trunc(y*-0.07::double)::bigint as y from cont", "cont"))
def g11(spark: SparkSession, sf: str) -> DataFrame:
    scaled = geo.scale_points(F.col("points"), F.lit(0.03), F.lit(-0.07))
    return proxies.contours(spark, sf).select("slide_id", "cont_idx", F.posexplode(scaled).alias("k", "p")).select(
        "slide_id", "cont_idx", "k", "p.x", "p.y")


@query("g12_contour_centroid", sql("""
select slide_id, cont_idx, trunc(sign(m00)*m10/(abs(m00) + 1e-9::double))::bigint as cx, trunc(sign(m00)*m01/(abs(m00) + 1e-9::double))::bigint as cy from (
  select slide_id, cont_idx, sum(x1*y2 - x2*y1)::double / 2 as m00, sum((x1+x2)*(x1*y2 - x2*y1))::double / 6 as m10, sum((y1+y2)*(x1*y2 - x2*y1))::double / 6 as m01
  from edges group by all)""", "edges"))
def g12(spark: SparkSession, sf: str) -> DataFrame:
    cx, cy = geo.centroid(F.col("points"))
    return proxies.contours(spark, sf).select("slide_id", "cont_idx", cx.alias("cx"), cy.alias("cy"))


@query("g13_tile_box", sql(f"""
select slide_id, cont_idx, x as x_min, y as y_min, x + {PATCH} as x_max, y + {PATCH} as y_max from kept""", "edges", extra=tested("center")))
def g13(spark: SparkSession, sf: str) -> DataFrame:
    tiles = tiling.span_tiles(tiling.grid_spans(bounds(spark, sf), "center"))
    return tiling.tile_box(tiles, F.lit(PATCH))


BOXES = """
select slide_id, cont_idx, oy // 16 as min_row, bx // 16 as min_col, (oy+bh) // 16 as max_row, (bx+bw) // 16 as max_col, h as height, w as width
from bbox join levels using (slide_id) where level = 0"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r")
    base = F.get(F.col("levels"), F.lit(0))
    rects = proxies.contours(spark, sf).select("slide_id", "cont_idx", geo.bounding_rect(F.col("points")).alias("r"))

    def sixteenth(v):
        return F.floor(v / 16).cast("bigint")

    return rects.join(proxies.pyramid(spark, sf), "slide_id").select(
        "slide_id", "cont_idx", sixteenth(r["y"]).alias("min_row"), sixteenth(r["x"]).alias("min_col"),
        sixteenth(r["y"] + r["h"]).alias("max_row"), sixteenth(r["x"] + r["w"]).alias("max_col"),
        base["h"].alias("height"), base["w"].alias("width"))


@query("g14_sliding_windows", sql("""
select slide_id, cont_idx, pos_0, pos_1, 0 as padded from sb, lateral (select unnest(range(s0, e0 - 400 + 1, 300)) as pos_0), lateral (select unnest(range(s1, e1 - 500 + 1, 375)) as pos_1)
union all
select slide_id, cont_idx, pos_0, pos_1, 1 from sb, lateral (select unnest(range(s0, e0, 380)) as pos_0), lateral (select unnest(range(s1, e1, 480)) as pos_1)""",
    "cont", "levels", extra={**BASE, "boxes": BOXES, "sb": "select *, min_row*16 as s0, min_col*16 as s1, max_row*16 as e0, max_col*16 as e1 from boxes"}))
def g14(spark: SparkSession, sf: str) -> DataFrame:
    scaled = tiling.scale_boxes(boxes(spark, sf), F.lit(16.0), F.lit(16.0))
    keys = ["slide_id", "cont_idx", "pos_0", "pos_1"]
    inner = tiling.sliding_windows(scaled, ("height", "width"), (400, 500), 0.25)
    padded = tiling.sliding_windows(scaled, ("height", "width"), (400, 500), 20, padded=True)
    return inner.select(*keys, F.lit(0).alias("padded")).unionByName(padded.select(*keys, F.lit(1).alias("padded")))


MASK_PIXELS = "select slide_id, row, col from pixels where r < 200 and g < 200"


def mask_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.pixels(spark, sf).filter((F.col("r") < 200) & (F.col("g") < 200)).select("slide_id", "row", "col")


@query("g15_mask_centred_patches", sql("""
select slide_id, row, col, round_even((row + 0.5::double)*37.0::double - 112, 0)::bigint as y, round_even((col + 0.5::double)*37.0::double - 112, 0)::bigint as x, count(*) over (partition by slide_id) as n from mask""", "pixels", extra={"mask": MASK_PIXELS}))
def g15(spark: SparkSession, sf: str) -> DataFrame:
    mask = mask_pixels(spark, sf)
    counts = mask.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    return mask.join(counts, "slide_id").select(
        "slide_id", "row", "col", tiling.mask_patch(F.col("row"), 37.0, 224.0).alias("y"),
        tiling.mask_patch(F.col("col"), 37.0, 224.0).alias("x"), "n")


@query("g16_window_to_mask", sql("""
select slide_id, tile_id, round_even((y_min + 112)/32.0::double, 0)::bigint as mask_row, round_even((x_min + 112)/32.0::double, 0)::bigint as mask_col from tiles""", "tiles"))
def g16(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tile_scores(spark, sf).select(
        "slide_id", "tile_id", tiling.window_to_mask(F.col("y_min"), 32.0, 224.0).alias("mask_row"),
        tiling.window_to_mask(F.col("x_min"), 32.0, 224.0).alias("mask_col"))


def _filtered(mode: str) -> str:
    shift = {"center": "(200,200)", "basic": "(0,0)", "any": "(0,0),(0,400),(400,0),(400,400)", "all": "(0,0),(0,400),(400,0),(400,400)"}[mode]
    return f"select '{mode}' as mode, slide_id, tile_id, x_min, y_min, x_min + dx as px, y_min + dy as py from tiles, (values {shift}) s(dx, dy)"


@query("g17_filter_tiles", sql("""
select mode, slide_id, tile_id from (
  select mode, slide_id, tile_id, px, py, bool_or(odd and not on_edge) as inside from hit group by all)
group by all having case when mode = 'all' then bool_and(inside) else bool_or(inside) end""", "tiles", "edges",
    extra={"probe": " union all ".join(_filtered(m) for m in ("center", "basic", "any", "all")),
           "edges2": "select slide_id, cont_idx, 2*x1 as x1, 2*y1 as y1, 2*x2 as x2, 2*y2 as y2 from edges",
           "hit": pip("probe", "edges2", "slide_id", "mode, slide_id, tile_id, cont_idx, px, py")}))
def g17(spark: SparkSession, sf: str) -> DataFrame:
    doubled = proxies.contours(spark, sf).select(
        "slide_id", geo.scale_points(F.col("points"), F.lit(2.0), F.lit(2.0)).alias("points"))
    out = None
    for mode in ("center", "basic", "any", "all"):
        kept = tiling.filter_tiles(proxies.tile_scores(spark, sf), doubled, mode).select(
            F.lit(mode).alias("mode"), "slide_id", "tile_id")
        out = kept if out is None else out.unionByName(kept)
    return out


@query("g18_scale_boxes", sql("""
select slide_id, cont_idx, trunc(min_row*7.3::double)::bigint as start_0, trunc(min_col*6.9::double)::bigint as start_1,
  trunc(max_row*7.3::double)::bigint as end_0, trunc(max_col*6.9::double)::bigint as end_1 from boxes""", "cont", "levels", extra={**BASE, "boxes": BOXES}))
def g18(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.scale_boxes(boxes(spark, sf), F.lit(7.3), F.lit(6.9)).select(
        "slide_id", "cont_idx", "start_0", "start_1", "end_0", "end_1")


@query("g19_coord_product", sql("""
select slide_id, nation, x, y from slides, lateral (select unnest(range(slide_id % 5, 100, 30)) as x), lateral (select unnest(range(0, 40 + slide_id % 7, 20)) as y)""", "slides"))
def g19(spark: SparkSession, sf: str) -> DataFrame:
    sid = F.col("slide_id")
    zero = F.lit(0).cast("bigint")
    ranges = (sid % 5, F.lit(100).cast("bigint"), F.lit(30).cast("bigint")), (zero, sid % 7 + 40, F.lit(20).cast("bigint"))
    return tiling.coord_product(proxies.slides(spark, sf).select("slide_id", "nation"), *ranges)


@query("g20_ndp_coordinates", sql("""
select slide_id, tile_id, trunc(x_min*250.0::double - xo)::bigint as nm_x_min, trunc(y_max*500.0::double - yo)::bigint as nm_y_max,
  trunc((x_min + x_max)*125.0::double)::bigint as x_mean, trunc((y_min + y_max)*250.0::double)::bigint as y_mean from (
  select *, trunc((16000 + (slide_id % 7)*64) * 125.0::double)::bigint - (slide_id*11 - 500) as xo, trunc((12000 + (slide_id % 5)*64) * 250.0::double)::bigint - (300 - slide_id*7) as yo from tiles)""", "tiles"))
def g20(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.nanometre_columns(proxies.tile_scores(spark, sf), proxies.pyramid(spark, sf)).select(
        "slide_id", "tile_id", "nm_x_min", "nm_y_max", "x_mean", "y_mean")


@query("g21_crop_box", sql("""
select slide_id, tile_id, x_min - floor((x_max - x_min)*2 / 2.0)::bigint as crop_x, y_min - floor((y_max - y_min)*2 / 2.0)::bigint as crop_y,
  (x_max - x_min)*3 as crop_w, (y_max - y_min)*3 as crop_h from (select slide_id, tile_id, x_min, y_min, x_max - tile_id % 2 as x_max, y_max from tiles)""", "tiles"))
def g21(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators.triage import crop_box

    odd = proxies.tile_scores(spark, sf).withColumn("x_max", F.col("x_max") - F.col("tile_id") % 2)
    return crop_box(odd, 3).select("slide_id", "tile_id", "crop_x", "crop_y", "crop_w", "crop_h")


@query("g22_stitch_placement", sql("""
select slide_id, tile_id, px as place_x, py as place_y, greatest(0, least(7, 240 - px)) as place_w, greatest(0, least(7, 200 - py)) as place_h
from (select slide_id, tile_id, ceil(x_min/64.0)::bigint as px, ceil(y_min/64.0)::bigint as py from tiles)""", "tiles"))
def g22(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.tile_scores(spark, sf).select("slide_id", "tile_id", F.col("x_min").alias("x"), F.col("y_min").alias("y"))
    canvas = (F.lit(240).cast("bigint"), F.lit(200).cast("bigint"))
    return tiling.placement(tiles, F.lit(400), F.lit(64.0), *canvas).select(
        "slide_id", "tile_id", "place_x", "place_y", "place_w", "place_h")


@query("g23_mosaic_layout", sql("""
select slide_id, tile_id, (n % 10)*64 as cell_x, (n // 10)*64 as cell_y from (
  select slide_id, tile_id, row_number() over (partition by slide_id order by score desc, x_min, y_min, tile_id) - 1 as n from tiles where score > -1)""", "tiles"))
def g23(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators.triage import positives_ordered

    placed = positives_ordered(proxies.tile_scores(spark, sf), "score", -1.0)
    x, y = tiling.mosaic_cell(F.col("place") - 1)
    return placed.select("slide_id", "tile_id", x.alias("cell_x"), y.alias("cell_y"))


@query("g24_patch_level_coordinate", sql("""
select slide_id, tile_id, floor(x_min / d)::bigint as px, floor(y_min / d)::bigint as py from (select *, 3.0::double + slide_id % 4 as d from tiles)""", "tiles"))
def g24(spark: SparkSession, sf: str) -> DataFrame:
    d = F.lit(3.0) + F.col("slide_id") % 4
    return proxies.tile_scores(spark, sf).select(
        "slide_id", "tile_id", tiling.patch_level_coordinate(F.col("x_min"), d).alias("px"),
        tiling.patch_level_coordinate(F.col("y_min"), d).alias("py"))


@query("g25_random_offset", sql("""
select slide_id, -200 + cast('0x' || substr(md5('7|0|' || slide_id), 1, 8) as bigint) % 400 as offset_0,
  -50 + cast('0x' || substr(md5('7|1|' || slide_id), 1, 8) as bigint) % 100 as offset_1 from slides""", "slides"))
def g25(spark: SparkSession, sf: str) -> DataFrame:
    sid = F.col("slide_id")
    return proxies.slides(spark, sf).select(
        "slide_id", tiling.random_offset(sid, F.lit(-200), F.lit(200), 7, 0).alias("offset_0"),
        tiling.random_offset(sid, F.lit(-50), F.lit(50), 7, 1).alias("offset_1"))


RASTER = {
    "scont": "select slide_id, cont_idx, k, trunc(x/64.0::double)::bigint as x, trunc(y/64.0::double)::bigint as y from cont",
    "shole": "select slide_id, cont_idx, hole_idx, k, trunc(x/64.0::double)::bigint as x, trunc(y/64.0::double)::bigint as y from hole",
    "sedges": """select slide_id, cont_idx, -1 as hole_idx, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
from scont window w as (partition by slide_id, cont_idx order by k rows between unbounded preceding and unbounded following)
union all select slide_id, cont_idx, hole_idx, x, y, coalesce(lead(x) over w, first_value(x) over w), coalesce(lead(y) over w, first_value(y) over w)
from shole window w as (partition by slide_id, cont_idx, hole_idx order by k rows between unbounded preceding and unbounded following)""",
    "sarea": "select slide_id, cont_idx, row_number() over (partition by slide_id order by a desc) - 1 as rk from (select slide_id, cont_idx, abs(sum(x1*y2 - x2*y1)) as a from sedges where hole_idx = -1 group by all)",
    "span": "select slide_id, cont_idx, hole_idx, min(x1) as ax, max(x1) as bx, min(y1) as ay, max(y1) as bby from sedges group by all",
    "probe": "select slide_id, cont_idx, hole_idx, px, py from span, lateral (select unnest(range(ax, bx+1)) as px), lateral (select unnest(range(ay, bby+1)) as py)",
    "hit": pip("probe", "sedges", "slide_id, cont_idx, hole_idx", "slide_id, cont_idx, hole_idx, px, py"),
    "mask": """select slide_id, py as row, px as col from (select slide_id, px, py, rk*2 + case when hole_idx >= 0 then 1 else 0 end as seq from hit join sarea using (slide_id, cont_idx) where odd or on_edge)
group by all having max(seq) % 2 = 0""",
}


@query("g26_polygon_raster", sql("""
select s.slide_id, count(m.row) as pixels, coalesce(sum(m.row), 0) as rows_sum, coalesce(sum(m.col), 0) as cols_sum, round(count(m.row) / (250.0::double*200), 9) as fraction
from slides s left join mask m using (slide_id) group by all""", "slides", "cont", "hole", extra=RASTER))
def g26(spark: SparkSession, sf: str) -> DataFrame:
    def small(df: DataFrame) -> DataFrame:
        return df.withColumn("points", geo.scale_points(F.col("points"), F.lit(1 / 64.0), F.lit(1 / 64.0)))

    mask = tiling.raster(small(proxies.contours(spark, sf)), small(proxies.holes(spark, sf)))
    sizes = proxies.slides(spark, sf).select("slide_id", F.lit(250).alias("width"), F.lit(200).alias("height"))
    n = F.col("stop") - F.col("start") + 1
    sums = mask.groupBy("slide_id").agg(
        F.sum(F.col("row") * n).alias("rows_sum"), F.sum((F.col("start") + F.col("stop")) * n / 2).cast("bigint").alias("cols_sum"))
    return tiling.tissue_fraction(mask, sizes).join(sums, "slide_id", "left").select(
        "slide_id", "pixels", F.coalesce("rows_sum", F.lit(0)).alias("rows_sum"),
        F.coalesce("cols_sum", F.lit(0)).alias("cols_sum"), F.round("fraction", 9).alias("fraction"))
