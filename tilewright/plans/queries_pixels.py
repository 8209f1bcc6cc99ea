"""Catalogue entries: mask-level pixel analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright.operators import pixels as px, regions, runs
from tilewright.plans import proxies
from tilewright.plans.proxy_sql import sql
from tilewright.plans.registry import Registry

query = Registry()

GRAY = "(((r*19595 + g*38470 + b*7471 + 32768) >> 16))"


def _clamp(expr: str) -> str:
    return f"trunc(least(greatest({expr}, 0.0::double), 255.0::double))::bigint"


MEANS = f"select slide_id, floor(avg({GRAY}) + 0.5)::bigint as m from pixels group by slide_id"
GRAYED = f"select slide_id, row, col, r, g, b, m, {_clamp(f'm + ({GRAY} - m)*20.0::double')} <= 210 as gray_fg from pixels join means using (slide_id)"


def _od(c: str) -> str:
    return f"ln(greatest({c}/255.0::double, 0.000001::double)) / ln(0.000001::double)"


EOSIN = f"""greatest({_od('r')} * (-1.00767869::double) + {_od('g')} * 1.13473037::double + {_od('b')} * (-0.48041419::double), 0.0::double) > -ln(0.95::double) / (6*ln(10.0::double)*0.70::double)"""
MASKED = f"select *, {EOSIN} as eosin_fg from grayed"
COVER = "select slide_id, round_even(count(*) filter (where eosin_fg)*100.0::double / count(*), 0) as coverage from masked group by slide_id"
TISSUE = "select slide_id, row, col, case when coverage < 5 or coverage > 90 then gray_fg else eosin_fg end as fg from masked join cover using (slide_id)"
CHAIN = {"means": MEANS, "grayed": GRAYED, "masked": MASKED, "cover": COVER, "tissue": TISSUE}


@query("x1_enhance_contrast", sql(f"""
select slide_id, row, col, {_clamp('m + (r - m)*1.7::double')} as r, {_clamp('m + (g - m)*1.7::double')} as g, {_clamp('m + (b - m)*1.7::double')} as b
from pixels join means using (slide_id)""", "pixels", extra=CHAIN))
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return px.enhance_contrast(proxies.pixels(spark, sf), 1.7)


@query("x2_eosin_mask", sql("select slide_id, row, col, eosin_fg as fg from masked", "pixels", extra=CHAIN))
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return px.eosin_mask(proxies.pixels(spark, sf)).select("slide_id", "row", "col", "fg")


@query("x3_gray_mask", sql("select slide_id, row, col, gray_fg as fg from grayed", "pixels", extra=CHAIN))
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return px.gray_mask(proxies.pixels(spark, sf)).select("slide_id", "row", "col", "fg")


@query("x4_coverage_fallback", sql("""
select slide_id, coverage, fg_pixels from cover join (select slide_id, count(*) filter (where fg) as fg_pixels from tissue group by slide_id) using (slide_id)""", "pixels", extra=CHAIN))
def x4(spark: SparkSession, sf: str) -> DataFrame:
    image = proxies.pixels(spark, sf)
    share = px.coverage(px.eosin_mask(image))
    found = px.tissue_mask(image).groupBy("slide_id").agg(F.count_if("fg").alias("fg_pixels"))
    return share.join(found, "slide_id")


HSV = """
select slide_id, row, col, r, g, b, trunc(hue*255)::integer as h8, trunc(sat*255)::integer as s8, trunc((t/255.0::double)*255)::integer as v8, hue, sat from (
  select *, case when t = 0 then 0.0::double else (t - l)::double / t end as sat, sector/6.0::double - floor(sector/6.0::double) as hue from (
    select *, case when t = l then 0.0::double when b = t then (r - g)::double/(t - l) + 4.0::double when g = t then (b - r)::double/(t - l) + 2.0::double else (g - b)::double/(t - l) end as sector
    from (select *, greatest(r, g, b) as t, least(r, g, b) as l from pixels)))"""
PENS = """
select *, v8 <= 165 as pen_black, h8 between 130 and 180 and s8 >= 50 and v8 >= 30 as pen_blue, h8 between 30 and 130 and s8 >= 30 and v8 >= 50 as pen_green,
  (h8 between 0 and 30 and s8 >= 30 and v8 >= 30) or (h8 between 200 and 255 and s8 >= 100 and v8 >= 100) as pen_red from hsv"""


@query("x5_pen_marker_flags", sql("""
select slide_id, row, col, pen_black, pen_blue, pen_green, pen_red from pens""", "pixels", extra={"hsv": HSV, "pens": PENS}))
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return px.pen_flags(proxies.pixels(spark, sf)).select(
        "slide_id", "row", "col", "pen_black", "pen_blue", "pen_green", "pen_red")


ELLIPSE = "(values (-2,0),(-1,-2),(-1,-1),(-1,0),(-1,1),(-1,2),(0,-2),(0,-1),(0,0),(0,1),(0,2),(1,-2),(1,-1),(1,0),(1,1),(1,2),(2,0)) k(dr,dc)"
SQUARE = "(values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) k(dr,dc)"
IN_IMAGE = "row + dr between 0 and 23 and col + dc between 0 and 31"


def _open_sql(name: str, source: str) -> dict[str, str]:
    return {
        f"{name}_set": source,
        f"{name}_gone": f"select distinct p.slide_id, p.row, p.col from pixels p, {ELLIPSE} where {IN_IMAGE} and not exists (select 1 from {name}_set s where s.slide_id = p.slide_id and s.row = p.row + dr and s.col = p.col + dc)",
        f"{name}_core": f"select slide_id, row, col from {name}_set anti join {name}_gone using (slide_id, row, col)",
        f"{name}_open": f"select distinct slide_id, row + dr as row, col + dc as col from {name}_core, {ELLIPSE} where {IN_IMAGE}",
    }


OPENED = {
    "hsv": HSV, "pens": PENS, **_open_sql("black", "select slide_id, row, col from pens where pen_black"),
    **_open_sql("red", "select slide_id, row, col from pens where pen_red"),
    "marks": """select slide_id, row, col from black_open union select slide_id, row, col from red_open
union select slide_id, row, col from pens where pen_blue or pen_green""",
    "grown": f"select distinct slide_id, row + dr as row, col + dc as col from marks, {SQUARE} where {IN_IMAGE}",
}


@query("x6_morphology", sql("""
select 'open' as kind, slide_id, row, col from black_open union all select 'dilate', slide_id, row, col from grown""", "pixels", extra=OPENED))
def x6(spark: SparkSession, sf: str) -> DataFrame:
    image, extent = proxies.pixels(spark, sf), sizes(spark, sf)
    black = runs.from_pixels(px.pen_flags(image, ("black",)).filter("pen_black"))
    opened = runs.to_pixels(runs.opened(black, extent)).select(F.lit("open").alias("kind"), "slide_id", "row", "col")
    grown = runs.to_pixels(px.pen_marker_runs(image, extent, grow=3))
    return opened.unionByName(grown.select(F.lit("dilate").alias("kind"), "slide_id", "row", "col"))


@query("x7_combine_masks", sql("""
select 'tissue' as kind, slide_id, row, col from tissue t where fg and not exists (select 1 from red_blue m where m.slide_id = t.slide_id and m.row = t.row and m.col = t.col)
union all select 'inverted', slide_id, row, col from tissue t where not fg or exists (select 1 from red_blue m where m.slide_id = t.slide_id and m.row = t.row and m.col = t.col)""",
    "pixels", extra={**CHAIN, **OPENED, "red_blue": "select slide_id, row, col from red_open union select slide_id, row, col from pens where pen_blue"}))
def x7(spark: SparkSession, sf: str) -> DataFrame:
    image, extent = proxies.pixels(spark, sf), sizes(spark, sf)
    tissue = runs.from_pixels(px.foreground(px.tissue_mask(image)))
    marks = px.pen_marker_runs(image, extent, ("blue", "red"))
    kept = runs.to_pixels(px.combine(tissue, marks, extent)).select(F.lit("tissue").alias("kind"), "slide_id", "row", "col")
    rest = runs.to_pixels(px.combine(tissue, marks, extent, invert=True))
    return kept.unionByName(rest.select(F.lit("inverted").alias("kind"), "slide_id", "row", "col"))


OTSU = """
select slide_id, arg_min(v, (-score, v)) as threshold from (
  select a.slide_id, a.v, round(coalesce(sum(b.n) filter (where b.v <= a.v) * sum(b.n) filter (where b.v > a.v) *
    pow(sum(b.v*b.n) filter (where b.v <= a.v)::double / sum(b.n) filter (where b.v <= a.v) - sum(b.v*b.n) filter (where b.v > a.v)::double / sum(b.n) filter (where b.v > a.v), 2), 0.0::double), 6) as score
  from hist a join hist b using (slide_id) group by a.slide_id, a.v) group by slide_id"""
HIST = "select slide_id, r as v, count(*) as n from pixels group by all"


@query("x8_channel_thresholds", sql(f"""
select slide_id, row, col, (r <= threshold or g <= 120) and sat > 0.02 as fg, (({GRAY}) <= 150) as dark from hsv join otsu using (slide_id)""",
    "pixels", extra={"hsv": HSV, "hist": HIST, "otsu": OTSU}))
def x8(spark: SparkSession, sf: str) -> DataFrame:
    image = proxies.pixels(spark, sf)
    both = px.channel_mask(image, {"R": "otsu", "G": 120, "S": 0.02})
    dark = px.channel_mask(image, {"L": 150}).select("slide_id", "row", "col", F.col("fg").alias("dark"))
    # Pixels are planned as small as the slides they come from; the hint keeps them off the driver.
    return both.select("slide_id", "row", "col", "fg").join(dark.hint("merge"), ["slide_id", "row", "col"])


@query("u4_custom_threshold", sql("""
select slide_id, row, col, 255 - b <= t as fg from pixels join (select slide_id, avg(255 - b) + 10 as t from pixels group by slide_id) using (slide_id)""", "pixels"))
def u4(spark: SparkSession, sf: str) -> DataFrame:
    def above_mean(image: DataFrame, channel: str) -> DataFrame:
        return image.groupBy("slide_id").agg((F.avg(channel) + 10).alias("threshold"))

    return px.channel_mask(proxies.pixels(spark, sf), {"B": above_mean}, invert=True).select("slide_id", "row", "col", "fg")


# ---------------------------------------------------------------- regions

MASK = "select slide_id, row, col from pixels where r < 200 and g < 200"
SPAN = 2147483648
EIGHT = "(values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr,dc)"
FOUR = "(values (-1,0),(0,-1),(0,1),(1,0)) o(dr,dc)"


def _label_sql(mask: str, prefix: str = "") -> dict[str, str]:
    """Flood from the pixels that have no earlier neighbour; the earliest flood names a region."""
    return {
        f"{prefix}seeds": f"""select slide_id, row, col from {mask} m where not exists (select 1 from {mask} n where n.slide_id = m.slide_id and
  ((n.row = m.row - 1 and n.col between m.col - 1 and m.col + 1) or (n.row = m.row and n.col = m.col - 1)))""",
        f"{prefix}reach": f"""select slide_id, row*{SPAN} + col as seed, row, col from {prefix}seeds
union select r.slide_id, r.seed, m.row, m.col from {prefix}reach r cross join {EIGHT} join {mask} m on m.slide_id = r.slide_id and m.row = r.row + o.dr and m.col = r.col + o.dc""",
        f"{prefix}labelled": f"select slide_id, row, col, min(seed) as region from {prefix}reach group by all",
    }


LABEL = {"mask": MASK, **_label_sql("mask")}
PROPS = {**LABEL, "props": """
select slide_id, region, count(*) as area, avg(row) as centroid_row, avg(col) as centroid_col, min(row) as min_row, min(col) as min_col,
  max(row) + 1 as max_row, max(col) + 1 as max_col from labelled group by all"""}


def base_mask(spark: SparkSession, sf: str) -> DataFrame:
    dark = proxies.pixels(spark, sf).filter((F.col("r") < 200) & (F.col("g") < 200))
    return runs.from_pixels(dark)


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.slides(spark, sf).select(
        "slide_id", F.lit(proxies.IMG_W).cast("bigint").alias("width"), F.lit(proxies.IMG_H).cast("bigint").alias("height"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return runs.label_runs(base_mask(spark, sf))


@query("x9_label_regions", sql("select * from labelled", "pixels", extra=LABEL, recursive=True))
def x9(spark: SparkSession, sf: str) -> DataFrame:
    return runs.to_pixels(labelled(spark, sf), ["region"])


def properties(spark: SparkSession, sf: str) -> DataFrame:
    return runs.region_properties(labelled(spark, sf))


@query("x10_region_properties", sql("""
select slide_id, region, area, round(centroid_row, 9) as centroid_row, round(centroid_col, 9) as centroid_col, min_row, min_col, max_row, max_col,
  row_number() over (partition by slide_id order by area desc, region) - 1 as place from props""", "pixels", extra=PROPS, recursive=True))
def x10(spark: SparkSession, sf: str) -> DataFrame:
    ordered = regions.area_order(properties(spark, sf))
    return ordered.withColumns({c: F.round(c, 9) for c in ("centroid_row", "centroid_col")})


DISC = "(values " + ",".join(f"({a},{b})" for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9) + ") k(dr,dc)"
SMALL = {
    **LABEL,
    "boundary": f"""select distinct slide_id, region, row, col from labelled l cross join {FOUR}
where not exists (select 1 from mask m where m.slide_id = l.slide_id and m.row = l.row + o.dr and m.col = l.col + o.dc)""",
    "kept": "select slide_id, region from boundary group by all having count(*) >= 6",
    "big": f"select distinct slide_id, row + dr as row, col + dc as col from labelled semi join kept using (slide_id, region) cross join {DISC} where {IN_IMAGE}",
    **_label_sql("big", "b_"),
}


@query("x11_drop_small_regions", sql("select * from b_labelled", "pixels", extra=SMALL, recursive=True))
def x11(spark: SparkSession, sf: str) -> DataFrame:
    grown = runs.drop_small(labelled(spark, sf), sizes(spark, sf), 6)
    return runs.to_pixels(runs.label_runs(grown), ["region"])


HOLES = {
    "mask": MASK,
    "bg": "select slide_id, row, col from pixels anti join mask using (slide_id, row, col)",
    "air": f"""select slide_id, row, col from bg where row in (0, 23) or col in (0, 31)
union select a.slide_id, b.row, b.col from air a cross join {FOUR} join bg b on b.slide_id = a.slide_id and b.row = a.row + o.dr and b.col = a.col + o.dc""",
}


@query("x12_fill_holes", sql("""
select slide_id, row, col from pixels anti join air using (slide_id, row, col)""", "pixels", extra=HOLES, recursive=True))
def x12(spark: SparkSession, sf: str) -> DataFrame:
    return runs.to_pixels(runs.fill_holes(base_mask(spark, sf), sizes(spark, sf)))


EPS = 9.0
CLUSTER = {
    **PROPS,
    "placed": "select *, row_number() over (partition by slide_id order by area desc, region) - 1 as place from props",
    "near": f"""select slide_id, place as origin, place, centroid_row, centroid_col from placed
union select p.slide_id, n.origin, p.place, p.centroid_row, p.centroid_col from near n join placed p on p.slide_id = n.slide_id
  and pow(p.centroid_row - n.centroid_row, 2) + pow(p.centroid_col - n.centroid_col, 2) <= {EPS * EPS}""",
    "firsts": "select slide_id, place, min(origin) as first_place from near group by all",
    "clustered": "select *, dense_rank() over (partition by slide_id order by first_place) - 1 as cluster from firsts join placed using (slide_id, place)",
}
FILLED = {
    **CLUSTER,
    "box": "select slide_id, region, r as row, c as col from props, lateral (select unnest(range(min_row, max_row)) as r), lateral (select unnest(range(min_col, max_col)) as c)",
    "gap": "select b.* from box b anti join labelled using (slide_id, region, row, col)",
    "outer_gap": f"""select g.slide_id, g.region, g.row, g.col from gap g join props p using (slide_id, region)
where g.row in (p.min_row, p.max_row - 1) or g.col in (p.min_col, p.max_col - 1)
union select a.slide_id, a.region, g.row, g.col from outer_gap a cross join {EIGHT} join gap g on g.slide_id = a.slide_id and g.region = a.region and g.row = a.row + o.dr and g.col = a.col + o.dc""",
    "filled": """select slide_id, region, (max_row - min_row)*(max_col - min_col) - coalesce(n, 0) as filled_area from props
left join (select slide_id, region, count(*) as n from outer_gap group by all) using (slide_id, region)""",
    "boxes": """select slide_id, cluster, min(min_row) as min_row, min(min_col) as min_col, max(max_row) as max_row, max(max_col) as max_col,
  sum(filled_area)::bigint as filled_area, count(*) as members from clustered join filled using (slide_id, region) group by all""",
}


@query("x13_cluster_regions", sql("select slide_id, region, place, cluster from clustered", "pixels", extra=CLUSTER, recursive=True))
def x13(spark: SparkSession, sf: str) -> DataFrame:
    return regions.cluster_regions(properties(spark, sf), EPS).select("slide_id", "region", "place", "cluster")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = labelled(spark, sf)
    grouped = regions.cluster_regions(runs.region_properties(found), EPS)
    return regions.cluster_boxes(grouped, regions.filled_area(found))


@query("x14_cluster_boxes", sql("select * from boxes", "pixels", extra=FILLED, recursive=True))
def x14(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(spark, sf)


@query("x15_keep_exclude_ids", sql("""
select slide_id, cluster from (select distinct slide_id, cluster from clustered) where case slide_id % 3 when 0 then cluster not in (1, 90) when 1 then cluster in (0, 2) and cluster <> 2 else true end""",
    "pixels", extra=CLUSTER, recursive=True))
def x15(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions.names import id_list

    case = F.col("slide_id") % 3
    found = regions.cluster_regions(properties(spark, sf), EPS).select("slide_id", "cluster").distinct().withColumns({
        "keep_ids": id_list(F.when(case == 1, "0,2").otherwise("none")),
        "exclude_ids": id_list(F.when(case == 0, "1,90").when(case == 1, "2").otherwise("none"))})
    return regions.choose_clusters(found).select("slide_id", "cluster")


@query("x16_largest_clusters", sql("""
select slide_id, cluster, filled_area, rank from (select *, row_number() over (partition by slide_id order by filled_area desc, cluster) as rank from boxes) where rank <= 2""",
    "pixels", extra=FILLED, recursive=True))
def x16(spark: SparkSession, sf: str) -> DataFrame:
    return regions.largest_clusters(clusters(spark, sf), 2).select("slide_id", "cluster", "filled_area", "rank")


@query("x17_white_black_patches", sql("""
select slide_id, tile_row, tile_col, avg(case when t = 0 then 0.0::double else round((t - l)*255.0::double/t, 0) end) < 15 as is_white, avg(r) < 50 and avg(g) < 50 and avg(b) < 50 as is_black,
  count(*) filter (where r < 20 and g < 20 and b < 20) > count(*)*0.05 as is_black_s,
  count(*) filter (where r > 220 and g > 220 and b > 220) > count(*)*0.2 as is_white_s
from (select *, row // 4 as tile_row, col // 4 as tile_col, greatest(r, g, b) as t, least(r, g, b) as l from pixels) group by all""", "pixels"))
def x17(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.pixels(spark, sf).withColumns({
        "tile_row": F.floor(F.col("row") / 4).cast("bigint"), "tile_col": F.floor(F.col("col") / 4).cast("bigint")})
    return px.patch_tests(tiles, ["slide_id", "tile_row", "tile_col"])


@query("x18_foreground_locations", sql("select slide_id, row, col from tissue where fg", "pixels", extra=CHAIN))
def x18(spark: SparkSession, sf: str) -> DataFrame:
    return px.foreground(px.tissue_mask(proxies.pixels(spark, sf)))
