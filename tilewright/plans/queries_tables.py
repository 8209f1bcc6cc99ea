"""Catalogue entries: sources and sinks, scalar functions, collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilewright import config
from tilewright.functions import names, pyramid as pyr, vectors
from tilewright.operators import collate, triage
from tilewright.plans import proxies
from tilewright.plans.proxy_sql import sql
from tilewright.plans.registry import Registry
from tilewright.sources import annotations, tables

query = Registry()


# ------------------------------------------------------- sources and sinks

@query("s1_list_slides", sql("""
select slide_name as slide_id, '/archive/' || nation || '/' || slide_name as path from slides""", "slides"))
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Slides lie beside their thumbnails, which the extension filter leaves out."""
    named = proxies.slides(spark, sf)
    folder = F.concat(F.lit("/archive/"), F.col("nation").cast("string"), F.lit("/"))
    files = named.select(F.concat(folder, "slide_name").alias("path")).unionByName(
        named.select(F.concat(folder, names.stem(F.col("slide_name")), F.lit(".jpg")).alias("path")))
    return tables.slide_files(files, ("ndpi", "svs"))


@query("s2_read_process_list", sql("select slide_name as slide_id from slides", "slides"))
def s2(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.scratch_path(spark, "process") + ".txt"
    proxies.slides(spark, sf).select("slide_name").write.text(path)
    return tables.read_process_list(spark, path)


LISTED = """
select slide_id, case when slide_id % 3 = 0 then cast(nation as integer) end as seg_level,
  case when slide_id % 4 = 1 then 'gray' end as based_on from slides"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    sid = F.col("slide_id")
    return proxies.slides(spark, sf).select(
        "slide_id", F.when(sid % 3 == 0, F.col("nation").cast("int")).alias("seg_level"),
        F.when(sid % 4 == 1, "gray").alias("based_on"),
    )


@query("s3_apply_preset", sql("""
select slide_id, 'mask' as based_on, 7 as a_t, 250 as max_dist, 'basic' as contour_fn from l""", "slides", extra={"l": LISTED}))
def s3(spark: SparkSession, sf: str) -> DataFrame:
    full = tables.init_process_list(listed(spark, sf))
    preset = spark.createDataFrame([("mask", "7", "basic")], "based_on string, a_t string, contour_fn string")
    return tables.apply_preset(full, preset).select(
        "slide_id", "based_on", F.col("a_t").cast("int").alias("a_t"), F.col("max_dist").cast("int").alias("max_dist"), "contour_fn"
    )


@query("s4_init_process_list", sql("""
select slide_id, 1 as process, 'tbp' as status, coalesce(seg_level, -1) as seg_level, coalesce(based_on, 'hed') as based_on,
  1 as contrast, 'none' as keep_ids, 'none' as exclude_ids, 25 as min_pixel_count, 20 as a_t, 16 as a_h, 2 as max_n_holes,
  250 as max_dist, -1 as vis_level, 250 as line_thickness, true as use_padding, 'four_pt' as contour_fn, -1 as label,
  15 as white_thresh, 50 as black_thresh, cast(null as double) as x1, cast(null as double) as y2 from l""", "slides", extra={"l": LISTED}))
def s4(spark: SparkSession, sf: str) -> DataFrame:
    full = tables.init_process_list(listed(spark, sf), heatmap=True, patches=True).drop("x2", "y1")
    ints = ["process", "min_pixel_count", "a_t", "a_h", "max_n_holes", "max_dist", "line_thickness", "white_thresh", "black_thresh"]
    return full.withColumns({c: F.col(c).cast("int") for c in ints})


@query("s5_tile_predictions_store", sql("""
select s.stain, 'v1' as model_ver, slide_id, count(*) as tiles, round(sum(score), 4) as total
from tiles, (values ('p53'),('tff3')) s(stain) group by all""", "tiles"))
def s5(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.scratch_path(spark, "predictions")
    for stain in ("p53", "tff3"):
        tiles = proxies.tile_scores(spark, sf).withColumns({"stain": F.lit(stain), "model_ver": F.lit("v1")})
        for _ in range(2):  # a repeated run adds nothing
            tables.write_predictions(tiles, path)
    return tables.read_predictions(spark, path).groupBy("stain", "model_ver", "slide_id").agg(
        F.count(F.lit(1)).alias("tiles"), F.round(F.sum("score"), 4).alias("total")
    )


def tile_sets(spark: SparkSession, sf: str) -> DataFrame:
    level = F.get(F.col("levels"), F.lit(0))
    return proxies.pyramid(spark, sf).select(
        "slide_id", F.lit(400).alias("patch_size"), F.lit(0).alias("patch_level"),
        F.array(F.lit(1.0), F.lit(1.0)).alias("downsample"), F.array(level["w"], level["h"]).alias("level_dim"),
        F.array(level["w"], level["h"]).alias("downsampled_level_dim"), F.lit("patches").alias("save_path"),
    )


def store_coords(spark: SparkSession, sf: str) -> str:
    """Tiles in two calls; what the first has stored must be kept once."""
    path = tables.scratch_path(spark, "coords")
    tiles = proxies.tile_scores(spark, sf).select("slide_id", F.col("x_min").alias("x"), F.col("y_min").alias("y"), "tile_id")
    early = F.col("slide_id") % 2 == 0
    for part in (tiles.filter(early), tiles):  # the second call finds some slides stored
        tables.append_coords(part, tile_sets(spark, sf), path)
    return path


@query("s6_append_coords", sql("""
select slide_id, 400 as patch_size, n as coords, 1 as attribute_rows, sx from (
select slide_id, count(*) as n, sum(x_min) as sx from tiles group by slide_id)""", "tiles"))
def s6(spark: SparkSession, sf: str) -> DataFrame:
    path = store_coords(spark, sf)
    attrs = spark.read.parquet(f"{path}/tile_sets").groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("attribute_rows"), F.max("patch_size").alias("patch_size"))
    coords = spark.read.parquet(f"{path}/tiles").groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("coords"), F.sum("x").alias("sx"))
    return coords.join(attrs, "slide_id")


@query("s7_append_patch_bag", sql("""
select slide_id, x_min as x, y_min as y, md5(cast(tile_id as varchar)) as img from tiles""", "tiles"))
def s7(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.scratch_path(spark, "bag")
    patches = proxies.tile_scores(spark, sf).select(
        "slide_id", F.col("x_min").alias("x"), F.col("y_min").alias("y"),
        F.unhex(F.md5(F.col("tile_id").cast("string"))).alias("img"),
    )
    for _ in range(2):
        tables.append_bag(patches, path)
    return spark.read.parquet(path).select("slide_id", "x", "y", F.lower(F.hex("img")).alias("img"))


@query("s8_read_coords", sql("""
select slide_id, x_min as x, y_min as y, 400 as patch_size, 0 as patch_level, 16000 + (slide_id % 7)*64 as width from tiles""", "tiles"))
def s8(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_coords(spark, store_coords(spark, sf)).select(
        "slide_id", "x", "y", "patch_size", "patch_level", F.get("level_dim", F.lit(0)).alias("width")
    )


@query("s9_column_groups", sql("""
select tile_id, 'slide' || cast(slide_id as varchar) as image, y_min as loc0, x_min as loc1, score as label from tiles""", "tiles"))
def s9(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.tile_scores(spark, sf).withColumn("path", F.concat(F.lit("slide"), F.col("slide_id").cast("string")))
    packed = tables.column_groups(
        tiles, {"image": "path", "location": ["y_min", "x_min"], "label": "score"}, keep=["tile_id"])
    return packed.select(
        "tile_id", "image", F.get("location", F.lit(0)).alias("loc0"), F.get("location", F.lit(1)).alias("loc1"), "label")


@query("s10_skip_existing", sql("""
select slide_id, case when slide_id in (select slide_id from tiles where score > 0.99) then 'already_exist' else 'tbp' end as status,
  case when slide_id in (select slide_id from tiles where score > 0.99) then 0 else 1 end as process from slides""", "tiles", "slides"))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    done = proxies.tile_scores(spark, sf).filter(F.col("score") > 0.99).select("slide_id")
    todo = tables.init_process_list(proxies.slides(spark, sf).select("slide_id"))
    return tables.skip_existing(todo, done).select("slide_id", "status", F.col("process").cast("int").alias("process"))


@query("s11_contours_from_xml", sql("""
select cast(slide_id as varchar) as slide, cont_idx, k, x, y from cont""", "cont"))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions import geometry as geo

    path = tables.scratch_path(spark, "xml")
    corner = F.transform("points", lambda p, i: F.concat(
        F.lit('<Coordinate Order="'), i.cast("string"), F.lit('" X="'), p["x"].cast("string"), F.lit('.75" Y="'),
        p["y"].cast("string"), F.lit('.25" />')))
    marks = proxies.contours(spark, sf).select("slide_id", F.concat(
        F.lit('<Annotation Name="'), F.col("slide_id").cast("string"), F.lit('"><Coordinates>'), F.array_join(corner, ""),
        F.lit("</Coordinates></Annotation>")).alias("line"))
    # One file per slide, as a slide viewer saves them; a slide has three annotations here.
    documents = marks.groupBy("slide_id").agg(F.array_join(F.collect_list("line"), "").alias("body")).select(
        "slide_id", F.concat(F.lit("<Root><Annotations>"), F.col("body"), F.lit("</Annotations></Root>")).alias("line"))
    documents.write.partitionBy("slide_id").text(path)
    rows = annotations.contours_from_xml(spark, path, keep=["_Name"])
    ranked = geo.sort_by_area(rows.withColumnRenamed("_Name", "slide"), ["slide"])
    # Areas: the L and the triangle exceed the rectangle, so the ranks name the three shapes.
    original = F.when(F.col("cont_rank") == 0, 1).when(F.col("cont_rank") == 1, 2).otherwise(0)
    return ranked.select("slide", original.alias("cont_idx"), F.posexplode("points").alias("k", "p")).select(
        "slide", "cont_idx", "k", "p.x", "p.y")


@query("s12_contours_from_text", sql("""
select slide_id, cont_idx, k, x, y from cont""", "cont"))
def s12(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    # Contour 1 arrives as two joined segments of another geometry type.
    n = F.size(pairs)
    segments = F.array(F.array(F.slice(pairs, 1, 2), F.slice(pairs, 3, n)))
    group = F.when(
        F.col("cont_idx") == 1,
        F.concat(F.lit('{"type":"MultiLine","coordinates":'), F.to_json(segments), F.lit("}")),
    ).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.array(pairs)), F.lit("}")))
    texts = proxies.contours(spark, sf).select("slide_id", "cont_idx", F.concat(F.lit("["), group, F.lit("]")).alias("text"))
    rows = annotations.contours_from_text(texts.withColumn("key", F.struct("slide_id", "cont_idx")), slide="key")
    return rows.select("key.slide_id", "key.cont_idx", F.posexplode("points").alias("k", "p")).select(
        "slide_id", "cont_idx", "k", "p.x", "p.y")


@query("s13_save_load_contours", sql("select slide_id, cont_idx, k, x, y from cont", "cont"))
def s13(spark: SparkSession, sf: str) -> DataFrame:
    back = tables.round_trip(proxies.contours(spark, sf), "contours")
    return back.select("slide_id", "cont_idx", F.posexplode("points").alias("k", "p")).select(
        "slide_id", "cont_idx", "k", "p.x", "p.y")


PLACED = """
select *, row_number() over (partition by slide_id order by score desc, x_min, y_min, tile_id) as place
from tiles where score > 0.98"""
ENDS = "select slide_id, max(place) as last from placed group by slide_id"


@query("s14_to_geojson", sql("""
select slide_id, place as line_no, case when place > 1 then ',' else '' end ||
  '{"type":"Feature","id":"PathDetectionObject","geometry":{"type":"Polygon","coordinates":[[[' || x_min || ',' || y_min || '],[' || x_max || ',' || y_min
  || '],[' || x_max || ',' || y_max || '],[' || x_min || ',' || y_max || '],[' || x_min || ',' || y_min || ']]]},"properties":{"objectType":"annotation","name":"atypia_'
  || cast(round(score, 4) as varchar) || '_' || x_min || '_' || y_min || '","classification":{"name":"atypia","color":[0,0,255]}}}' as line from placed
union all select slide_id, 0, '{"type":"FeatureCollection","features":[' from ends
union all select slide_id, last + 1, ']}' from ends""", "tiles", extra={"placed": PLACED, "ends": ENDS}))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.geojson(proxies.tile_scores(spark, sf), "score", 0.98, "atypia")


@query("s15_to_asap_xml", sql("""
select slide_id, place as line_no, '<Annotation Name="atypia_' || cast(score as varchar) || '" Type="Polygon" PartOfGroup="atypia" Color="#F4FA58"><Coordinates><Coordinate Order="0" X="'
  || x_min || '" Y="' || y_min || '" /><Coordinate Order="1" X="' || x_max || '" Y="' || y_min || '" /><Coordinate Order="2" X="' || x_max || '" Y="' || y_max
  || '" /><Coordinate Order="3" X="' || x_min || '" Y="' || y_max || '" /></Coordinates></Annotation>' as line from placed
union all select slide_id, 0, '<?xml version="1.0"?><ASAP_Annotations><Annotations>' from ends
union all select slide_id, last + 1, '</Annotations><AnnotationGroups><Group Name="atypia" PartOfGroup="None" Color="#64FE2E"><Attributes /></Group></AnnotationGroups></ASAP_Annotations>' from ends""",
    "tiles", extra={"placed": PLACED, "ends": ENDS}))
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.asap_xml(proxies.tile_scores(spark, sf), "score", 0.98, "atypia")


NM = """
select p.*, trunc(x_min*250.0::double - xo)::bigint as x1, trunc(y_min*500.0::double - yo)::bigint as y1,
  trunc(x_max*250.0::double - xo)::bigint as x2, trunc(y_max*500.0::double - yo)::bigint as y2,
  trunc((x_min + x_max)*125.0::double)::bigint as xm, trunc((y_min + y_max)*250.0::double)::bigint as ym, xo, yo
from (select *, trunc((16000 + (slide_id % 7)*64) * 125.0::double)::bigint - (slide_id*11 - 500) as xo,
        trunc((12000 + (slide_id % 5)*64) * 250.0::double)::bigint - (300 - slide_id*7) as yo from placed) p"""


@query("s16_to_ndpa", sql("""
select slide_id, place as line_no, '<ndpviewstate id="' || (tile_id+1) || '"><title>atypia</title><details>These are the details of Annotation ' || (tile_id+1)
  || '</details><coordformat>nanometers</coordformat><lens>3.628447</lens><x>' || xm || '</x><y>' || ym || '</y><z>0</z><showtitle>1</showtitle><showhistogram>0</showhistogram><showlineprofile>0</showlineprofile><annotation type="freehand" displayname="AnnotateRectangle" color="#00ff00"><measuretype>0</measuretype><closed>1</closed><pointlist><point><x>'
  || x1 || '</x><y>' || y1 || '</y></point><point><x>' || x2 || '</x><y>' || y1 || '</y></point><point><x>' || x2 || '</x><y>' || y2 || '</y></point><point><x>' || x1 || '</x><y>' || y2
  || '</y></point></pointlist><specialtype>rectangle</specialtype></annotation></ndpviewstate>' as line from nm
union all select slide_id, 0, '<?xml version="1.0" encoding="utf-8"?><annotations>' from ends
union all select slide_id, last + 1, '</annotations>' from ends""", "tiles", extra={"placed": PLACED, "ends": ENDS, "nm": NM}))
def s16(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.ndpa(proxies.tile_scores(spark, sf), proxies.pyramid(spark, sf), "score", 0.98, "atypia")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    sid = F.col("slide_id")
    both = F.array(*[
        F.struct(F.lit(side).alias("side"), (sid % 50 + x).cast("double").alias("x"), F.lit(float(y)).alias("y"),
                 F.lit(float(w)).alias("w"), (sid % 9 + h).cast("double").alias("h"))
        for side, x, y, w, h in (("left", 10, 20, 100, 60), ("right", 300, 25, 90, 70))
    ])
    return proxies.slides(spark, sf).select(
        (sid + 1).alias("image_id"), F.col("slide_name").alias("file_name"), F.lit(640.0).alias("width"),
        F.lit(480.0).alias("height"), F.inline(both),
    )


@query("s17_to_coco", sql("""
select b.id, 1 as category_id, slide_id + 1 as image_id, slide_name as file_name, round(x/640.0::double, 9) as bx, round(y/480.0::double, 9) as by,
  round(w/640.0::double, 9) as bw, round(h/480.0::double, 9) as bh, round(w/640.0::double * (h/480.0::double), 9) as area from slides,
  lateral (select 2*(slide_id+1) - 1 as id, slide_id % 50 + 10 as x, 20 as y, 100 as w, slide_id % 9 + 60 as h
   union all select 2*(slide_id+1), slide_id % 50 + 300, 25, 90, slide_id % 9 + 70) b""", "slides"))
def s17(spark: SparkSession, sf: str) -> DataFrame:
    all_boxes = boxes(spark, sf)
    parts = [all_boxes.filter(F.col("image_id") % 2 == r) for r in (0, 1)]
    images, annots = annotations.merge_coco([
        (annotations.coco_images(p), annotations.coco_annotations(p)) for p in parts])
    bbox = [F.round(F.get("bbox", F.lit(i)), 9).alias(n) for i, n in enumerate(("bx", "by", "bw", "bh"))]
    return annots.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").select(
        "id", "category_id", "image_id", "file_name", *bbox, F.round("area", 9).alias("area"))


@query("s19_write_run_results", sql("""
select slide_id, case when n >= 10 then 3 when n > 0 then 2 else 1 end as algorithm_result, n as positive_tiles, 'he' as stain, '240105' as run_date
from (select slide_id, count(*) filter (where score > 0.99993) as n from tiles group by slide_id)""", "tiles"))
def s19(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.scratch_path(spark, "results")
    results = triage.triage_for_stain(proxies.tile_scores(spark, sf), "he", "score")
    for _ in range(2):
        tables.write_results(results, path, "he", F.to_date(F.lit("2024-01-05")))
    return spark.read.option("basePath", path).parquet(path).select(
        "slide_id", "algorithm_result", "positive_tiles", "stain", F.col("run_date").cast("string").alias("run_date"))


@query("s20_labelled_tiles", sql("""
select slide_name as case_file, t.tile_id, ['artifact','atypia','background','gastric_cardia','immune_cells','intestinal_metaplasia','respiratory_mucosa','squamous_mucosa'][cast(t.tile_id % 8 + 1 as integer)] as tile_class
from tiles t join slides using (slide_id) where nation % 2 = 0 and t.tile_id % 8 in (1, 3)""", "tiles", "slides"))
def s20(spark: SparkSession, sf: str) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in config.STAINS["he"]["classes"]])
    all_slides = proxies.slides(spark, sf)
    paths = proxies.tile_scores(spark, sf).join(all_slides, "slide_id").select(F.concat(
        F.lit("/data/tiles/"), names.case_name(F.col("slide_name")), F.lit("/"),
        F.get(classes, (F.col("tile_id") % 8).cast("int")), F.lit("/"), F.col("tile_id").cast("string"), F.lit(".png"),
    ).alias("path"))
    cases = all_slides.filter(F.col("nation") % 2 == 0).select(F.concat(F.lit("/val/"), F.col("slide_name")).alias("case"))
    kept = tables.labelled_tiles(paths, cases, ["atypia", "gastric_cardia"])
    return kept.select(
        F.concat(F.col("case"), F.lit(".ndpi")).alias("case_file"),
        names.stem(F.col("tile")).cast("bigint").alias("tile_id"), "tile_class")


# ---------------------------------------------------------------- scalars

@query("p1_parse_slide_id", sql("""
select slide_id, lpad(cast(slide_id as varchar), 5, '0') as sample_id, cast(nation as varchar) || '.ndpi' as pot_id,
  cast(null as varchar) as absent from slides""", "slides"))
def p1(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("slide_name")
    return proxies.slides(spark, sf).select(
        "slide_id", names.name_token(name, 0).alias("sample_id"), names.name_token(name, 2).alias("pot_id"),
        names.name_token(name, 3).alias("absent"))


@query("p2_stem", sql("""
select page_id, regexp_replace(f, '(.)\\.[^.]*$', '\\1') as stem from (select page_id, list_last(string_split(url, '/')) as f from pages)"""))
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.table(spark, sf, "pages").select("page_id", names.stem(F.col("url")).alias("stem"))


@query("p3_parse_model_name", sql("""
select p_partkey, case when p_partkey % 2 = 0 then 'he' else 'p53' end as stain, p_type as architecture from part"""))
def p3(spark: SparkSession, sf: str) -> DataFrame:
    part = proxies.table(spark, sf, "part")
    path = F.concat(
        F.lit("/models/a-b/size-"), F.when(F.col("p_partkey") % 2 == 0, "he").otherwise("p53"), F.lit("-"),
        F.col("p_size").cast("string"), F.lit("-27-"), F.col("p_type"), F.lit("-epoch-39_ft.pt"))
    return part.select(
        "p_partkey", names.model_part(path, 1).alias("stain"), names.model_part(path, 4).alias("architecture"))


@query("p4_level_downsamples", sql("""
select slide_id, level, round(first_value(w) over v / w::double, 9) as dx, round(first_value(h) over v / h::double, 9) as dy from levels
window v as (partition by slide_id order by level)""", "levels"))
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.pyramid(spark, sf).select(
        "slide_id", F.posexplode(pyr.level_downsamples(F.col("levels"))).alias("level", "d")
    ).select("slide_id", "level", F.round("d.dx", 9).alias("dx"), F.round("d.dy", 9).alias("dy"))


@query("p5_best_level", sql("""
select slide_id, coalesce(max(level) filter (where downsample <= 64), 0) as best64, coalesce(max(level) filter (where downsample <= 32), 0) as best32,
  case when slide_id % 2 = 0 then 1 else coalesce(max(level) filter (where downsample <= 64), 0) end as chosen from levels group by slide_id""", "levels"))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.col("levels")
    requested = F.when(F.col("slide_id") % 2 == 0, 1).otherwise(-1)
    return proxies.pyramid(spark, sf).select(
        "slide_id", pyr.best_level(levels, 64).alias("best64"), pyr.best_level(levels, 32).alias("best32"),
        pyr.chosen_level(requested, levels).alias("chosen"))


@query("p6_best_mask_level", sql("""
select slide_id, coalesce(max(level) filter (where w >= 1200), 0) as mask_level, coalesce(max(level) filter (where w >= 99999), 0) as none_wide
from levels group by slide_id""", "levels"))
def p6(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.col("levels")
    return proxies.pyramid(spark, sf).select(
        "slide_id", pyr.best_mask_level(levels).alias("mask_level"), pyr.best_mask_level(levels, 99999).alias("none_wide"))


@query("p7_oversize_guard", sql("""
select slide_id, case when w*h > 100000000 then 'failed_seg' else 'tbp' end as status from levels
where level = case when slide_id % 10 <> 9 and slide_id % 2 = 0 then 1 else 0 end""", "levels"))
def p7(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when((F.col("slide_id") % 10 != 9) & (F.col("slide_id") % 2 == 0), 1).otherwise(0)
    return proxies.pyramid(spark, sf).select(
        "slide_id", F.when(pyr.oversize(F.col("levels"), level), "failed_seg").otherwise("tbp").alias("status"))


@query("p8_parse_ids", sql("""
select c_custkey, case c_custkey % 4 when 0 then 0 when 1 then 0 when 2 then 1 else 2 end as n,
  case c_custkey % 4 when 2 then c_custkey % 10 when 3 then c_custkey % 10 else 0 end as total from customer"""))
def p8(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    last = (key % 10).cast("string")
    text = F.when(key % 4 == 0, "none").when(key % 4 == 1, F.lit(None).cast("string")).when(
        key % 4 == 2, last).otherwise(F.concat(F.lit("0, "), last))
    ids = names.id_list(text)
    return proxies.table(spark, sf, "customer").select(
        "c_custkey", F.size(ids).alias("n"), F.aggregate(ids, F.lit(0), lambda a, v: a + v).alias("total"))


@query("p9_legacy_area", sql("""
select slide_id, level, trunc((500 + slide_id*13) * (downsample*downsample) / 262144.0::double)::integer as a_t from levels""", "levels"))
def p9(spark: SparkSession, sf: str) -> DataFrame:
    flat = proxies.pyramid(spark, sf).select("slide_id", F.posexplode("levels").alias("level", "l"))
    d = F.col("l.downsample")
    return flat.select("slide_id", "level", pyr.legacy_area((F.lit(500) + F.col("slide_id") * 13).cast("double"), d, d).alias("a_t"))


@query("p10_area_thresholds", sql("""
select slide_id, level, 20 * trunc(262144.0::double / (downsample*downsample))::integer as a_t, 16 * trunc(262144.0::double / (downsample*downsample))::integer as a_h from levels""", "levels"))
def p10(spark: SparkSession, sf: str) -> DataFrame:
    flat = proxies.pyramid(spark, sf).select("slide_id", F.posexplode("levels").alias("level", "l"))
    ref = pyr.reference_area(F.col("l.downsample"), F.col("l.downsample"))
    return flat.select("slide_id", "level", (ref * 20).alias("a_t"), (ref * 16).alias("a_h"))


@query("p11_stain_config", sql("""
select c_custkey, stain, n_classes, case when c_custkey % 10 = 0 and stain <> 'tff3' then 'background' else ranked end as ranked_class, threshold, lcp,
  case when c_custkey % 6 = 0 then 7 else hcp end as hcp, mean0
from (select c_custkey, ['he','qc','p53','tff3'][cast(c_custkey % 4 + 1 as integer)] as stain from customer) join
 (values ('he',8,'atypia',0.99993::double,0,10,0.7747305964175918::double),('qc',4,'Gastric-type columnar epithelium',0.99::double,0,95,0.485::double),
  ('p53',6,'aberrant_positive_columnar',0.99::double,0,2,0.7747305964175918::double),('tff3',3,'Positive',0.93::double,3,40,0.485::double)) s(stain,n_classes,ranked,threshold,lcp,hcp,mean0) using (stain)"""))
def p11(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    stains = F.array(*[F.lit(s) for s in ("he", "qc", "p53", "tff3")])
    rows = proxies.table(spark, sf, "customer").select("c_custkey", F.get(stains, (key % 4).cast("int")).alias("stain"))
    full = config.with_stain_config(
        rows, ranked_class=F.when(key % 10 == 0, "background"), hcp=F.when(key % 6 == 0, 7))
    return full.select(
        "c_custkey", "stain", F.size("classes").alias("n_classes"), "ranked_class", "threshold", "lcp", "hcp",
        F.get("channel_means", F.lit(0)).alias("mean0"))


@query("p12_class_set", sql("""
select c_custkey, array_to_string(list_sort(['artifact','background','immune_cells','squamous_mucosa'] || case when not he then
   ['aberrant_positive_columnar','wild_type_columnar'] || case when p then [] else ['equivocal_columnar','nonspecific_background','oral_bacteria','respiratory_mucosa'] end
  else ['gastric_cardia','intestinal_metaplasia','respiratory_mucosa'] || case when a then ['atypia'] when d then
    case when r and g then ['other'] when r then ['other','tickled_up_columnar','atypia'] when g then ['other','respiratory_mucosa_cilia','atypia']
      else ['other','respiratory_mucosa_cilia','tickled_up_columnar','atypia'] end
    else ['atypia_of_uncertain_significance','other','dysplasia'] || case when r then [] else ['respiratory_mucosa_cilia'] end || case when g then [] else ['tickled_up_columnar'] end end end), ',') as classes
from (select c_custkey, c_custkey % 2 = 0 as he, (c_custkey // 2) % 2 = 1 as a, (c_custkey // 4) % 2 = 1 as d, (c_custkey // 8) % 2 = 1 as r,
  (c_custkey // 16) % 2 = 1 as g, (c_custkey // 32) % 2 = 1 as p from customer)"""))
def p12(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")

    def bit(n: int) -> Column:
        return F.shiftright(key, n).bitwiseAND(1) == 1

    classes = config.class_set(
        F.when(key % 2 == 0, "he").otherwise("p53"), bit(1), bit(2), bit(3), bit(4), bit(5))
    return proxies.table(spark, sf, "customer").select("c_custkey", F.array_join(classes, ",").alias("classes"))


@query("p13_map_labels", sql("""
select slide_id, code, case code when 'N' then 0 when 'EQV' then 0 when 'WT' then 1 when 'Y' then 1 end as p53_label,
  case code when 'N' then 0 when 'Y' then 1 end as he_label,
  ['Artifact','Atypia','Background','Gastric cardia','Immune cells','Intestinal metaplasia','Respiratory mucosa','Squamous mucosa'][cast(slide_id % 9 + 1 as integer)] as display from truth""", "truth"))
def p13(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions.labels import display_name, map_label

    return proxies.truth_codes(spark, sf).select(
        "slide_id", "code", map_label(F.col("code"), config.P53_LABELS).alias("p53_label"),
        map_label(F.col("code"), config.STAINS["he"]["label_map"]).alias("he_label"),
        display_name(F.col("slide_id") % 9, "he").alias("display"))


@query("p14_filter_labelled", sql("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, dysplasia, other_class from (select *, case when l_returnflag = 'A' then 1 else 0 end as auc, case when l_quantity > 25 then 1 else 0 end as dysplasia,
  case when l_discount > 0.05 then 1 else 0 end as other_class from lineitem) where auc = 1"""))
def p14(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions.labels import label_columns, labelled_subset

    li = proxies.table(spark, sf, "lineitem")
    annotated = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("atypia_of_uncertain_significance"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("dysplasia"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("other_class"))
    kept = labelled_subset(annotated)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *label_columns(kept))


@query("p15_resolve_path", sql("""
select slide_id, '/slides/' || replace(slide_name, '.ndpi', '') || '.svs' as path from slides""", "slides"))
def p15(spark: SparkSession, sf: str) -> DataFrame:
    path = names.joined_path(F.lit("/slides/"), names.stem(F.col("slide_name")), F.lit(".svs"))
    return proxies.slides(spark, sf).select("slide_id", path.alias("path"))


@query("p16_existence_check", sql("""
select o_custkey as slide_id, count(*) as waiting, exists (select 1 from supplier where s_suppkey = o_custkey) as found from orders group by o_custkey"""))
def p16(spark: SparkSession, sf: str) -> DataFrame:
    wanted = proxies.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("slide_id")).agg(F.count(F.lit(1)).alias("waiting"))
    found = proxies.slides(spark, sf).select("slide_id")
    return tables.present_files(wanted, found).withColumn("found", F.lit(True)).unionByName(
        tables.missing_files(wanted, found).withColumn("found", F.lit(False)))


@query("p17_normalise_pixels", sql("""
select slide_id, row, col, round((r/255.0::double - 0.485::double)/0.229::double, 9) as nr, round((g/255.0::double - 0.456::double)/0.224::double, 9) as ng,
  round((b/255.0::double - 0.406::double)/0.225::double, 9) as nb from pixels""", "pixels"))
def p17(spark: SparkSession, sf: str) -> DataFrame:
    means, stds = config.CHANNEL_STATS["qc"]
    scaled = vectors.scale_and_normalise(
        F.array("r", "g", "b"), F.array(*[F.lit(m) for m in means]), F.array(*[F.lit(s) for s in stds]))
    return proxies.pixels(spark, sf).select("slide_id", "row", "col", scaled.alias("v")).select(
        "slide_id", "row", "col", *[F.round(F.get("v", F.lit(i)), 9).alias(n) for i, n in enumerate(("nr", "ng", "nb"))])


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    logits = vectors.linear_head(F.col("features"), proxies.HEAD)
    return proxies.features(spark, sf).select("tile_id", "label", vectors.softmax(logits).alias("p"))


@query("p18_softmax", sql("select vec_id as tile_id, k, round(p, 9) as p from probs", "probs"))
def p18(spark: SparkSession, sf: str) -> DataFrame:
    return probabilities(spark, sf).select("tile_id", F.posexplode("p").alias("k", "v")).select(
        "tile_id", "k", F.round("v", 9).alias("p"))


@query("p19_argmax", sql("""
select vec_id as tile_id, arg_max(k, z) as y_hat from logits group by vec_id""", "logits"))
def p19(spark: SparkSession, sf: str) -> DataFrame:
    logits = vectors.linear_head(F.col("features"), proxies.HEAD)
    return proxies.features(spark, sf).select("tile_id", vectors.argmax(logits).alias("y_hat"))


@query("p20_one_hot", sql("""
select vec_id as tile_id, k, case when label = k then 1 else 0 end as hot from embeddings, range(10) c(k)"""))
def p20(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.features(spark, sf).select(
        "tile_id", F.posexplode(vectors.one_hot(F.col("label"), proxies.N_CLASSES)).alias("k", "hot"))


@query("p21_report_rounding", sql("""
select tile_id, slide_id, round(score, 4) as name_score, round(score, 6) as cut6, round(score, 7) as cut7 from tiles""", "tiles"))
def p21(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tile_scores(spark, sf).select(
        "tile_id", "slide_id", F.round("score", 4).alias("name_score"), F.round("score", 6).alias("cut6"),
        F.round("score", 7).alias("cut7"))


# -------------------------------------------------------------- collation

STAINS = ("qc", "he", "p53", "tff3")
CUTS = {"qc": (0.99, 0, 95), "he": (0.99993, 0, 10), "p53": (0.99, 0, 2), "tff3": (0.93, 3, 40)}


def stain_of() -> Column:
    """Number of the stain a tile was cut under; a sample has one to four stains, so the outer join has gaps."""
    return (F.col("slide_id") + F.col("tile_id") % (F.col("slide_id") % 4 + 1)) % 4


def stain_results(spark: SparkSession, sf: str, stain: str) -> DataFrame:
    tiles = proxies.tile_scores(spark, sf).filter(stain_of() == STAINS.index(stain))
    results = triage.triage_for_stain(tiles, stain, "score")
    return triage.slide_records(results, proxies.slides(spark, sf), f"{stain}-v1", ("json",))


def all_results(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {s: stain_results(spark, sf, s) for s in STAINS}


def _results_sql(stain: str) -> str:
    t, lo, hi = CUTS[stain]
    return f"""
select split_part(slide_name, ' ', 1) as sample_id, replace(slide_name, '.ndpi', '') as slide_filename, n as positive_tiles,
  case when n >= {hi} then 3 when n > {lo} then 2 else 1 end as algorithm_result,
  case when n > 0 then '{stain}-v1.geojson' end as tile_mapping, '{stain}-v1' as algorithm_version
from (select slide_id, count(*) filter (where score > {t}::double) as n from tiles where (slide_id + tile_id % (slide_id % 4 + 1)) % 4 = {STAINS.index(stain)} group by slide_id) join slides using (slide_id)"""


MERGED = """
select sample_id, qc.slide_filename as h_e_slide_filename, qc.positive_tiles as he_numb_gastric_tile_alg, qc.algorithm_result as h_e_qc_result_alg,
  qc.tile_mapping as qc_tile_mapping, qc.algorithm_version as qc_algorithm_version,
  he.positive_tiles as atypia_positive_tiles, he.algorithm_result as atypia_algorithm_result, he.tile_mapping as atypia_tile_mapping, he.algorithm_version as atypia_algorithm_version,
  p53.slide_filename as p53_slide_filename, p53.positive_tiles as p53_positive_tiles, p53.algorithm_result as p53_algorithm_result, p53.tile_mapping as p53_tile_mapping, p53.algorithm_version as p53_algorithm_version,
  tff3.slide_filename as tff3_slide_filename, tff3.positive_tiles as tff3_positive_tiles, tff3.algorithm_result as tff3_algorithm_result, tff3.tile_mapping as tff3_tile_mapping, tff3.algorithm_version as tff3_algorithm_version
from qc full join he using (sample_id) full join p53 using (sample_id) full join tff3 using (sample_id)"""
LISTS = {
    "primary_list": """
select lab, 'P' || cast(s_suppkey as varchar) as participant, s_suppkey as ord from (select s_suppkey, case when s_suppkey % 15 = 0 then null else lpad(cast(s_suppkey as varchar), 5, '0') end as lab from supplier where s_suppkey % 3 = 0)
union all select '00003', 'P-late', 1000000000""",
    "repeat_list": """
select lpad(cast(s_suppkey as varchar), 5, '0') as lab, 'R' || cast(s_suppkey // 2 as varchar) as participant, s_suppkey as ord from supplier where s_suppkey % 3 = 1 or s_suppkey % 12 = 0""",
    "primary_map": "select lab, arg_max(participant, ord) as participant, min(ord) as first_seen from primary_list where lab is not null group by lab",
    "repeat_map": "select lab, arg_max(participant, ord) as participant, min(ord) as first_seen from repeat_list where lab is not null group by lab",
}
COLLATE = {**{s: _results_sql(s) for s in STAINS}, "merged": MERGED, **LISTS, "looked": """
select coalesce(a.participant, b.participant) as record_id, case when a.lab is not null then 1 when b.lab is not null then 2 end as redcap_repeat_instance, m.*
from merged m left join primary_map a on a.lab = m.sample_id left join repeat_map b on b.lab = m.sample_id"""}


def participant_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = proxies.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    lab = F.lpad(key.cast("string"), 5, "0")
    primary = s.filter(key % 3 == 0).select(
        F.when(key % 15 != 0, lab).alias("lab_number"), F.concat(F.lit("P"), key.cast("string")).alias("participant_id"),
        key.alias("file_order"))
    late = spark.createDataFrame([("00003", "P-late", 1000000000)], primary.schema)
    repeat = s.filter((key % 3 == 1) | (key % 12 == 0)).select(
        lab.alias("lab_number"), F.concat(F.lit("R"), F.floor(key / 2).cast("string")).alias("participant_id"),
        key.alias("file_order"))
    return primary.unionByName(late), repeat


@query("j1_rename_per_stain", sql("""
select sample_id, slide_filename as p53_slide_filename, positive_tiles as p53_positive_tiles, algorithm_result as p53_algorithm_result,
  tile_mapping as p53_tile_mapping, algorithm_version as p53_algorithm_version from p53""", "tiles", "slides", extra={"p53": COLLATE["p53"]}))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return collate.rename_for_stain(stain_results(spark, sf, "p53"), "p53")


@query("j2_full_outer_collate", sql("select * from merged", "tiles", "slides", extra=COLLATE))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return collate.collate(all_results(spark, sf))


@query("j3_suffix_collision", sql("""
select sample_id, qc.slide_filename as kept_left, coalesce(qc.slide_filename, he.slide_filename) as filled from qc full join he using (sample_id)""", "tiles", "slides", extra=COLLATE))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    qc, he = (collate.rename_for_stain(stain_results(spark, sf, s), s) for s in ("qc", "he"))
    left = collate.merge_he(qc, he).select("sample_id", F.col("h_e_slide_filename").alias("kept_left"))
    full = collate.merge_he(qc, he, fill=True).select("sample_id", F.col("h_e_slide_filename").alias("filled"))
    return left.join(full, "sample_id")


@query("j4_id_lookup", sql("select sample_id, record_id, redcap_repeat_instance from looked", "tiles", "slides", extra=COLLATE))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return collate.lookup_ids(j2(spark, sf), *participant_lists(spark, sf)).select(
        "sample_id", "record_id", "redcap_repeat_instance")


@query("j5_unmatched_samples", sql("select sample_id from looked where redcap_repeat_instance is null", "tiles", "slides", extra=COLLATE))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return collate.unmatched(j2(spark, sf), *participant_lists(spark, sf))


@query("j6_export_columns", sql("""
select *, 'unscheduled_arm_1' as redcap_event_name, 'machine_learning_pathology_results' as redcap_repeat_instrument from looked""", "tiles", "slides", extra=COLLATE))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return collate.export_columns(collate.lookup_ids(j2(spark, sf), *participant_lists(spark, sf)))


@query("j7_missing_participants", sql("""
select instance, arg_max(lab, first_seen) as lab_number from (
  select participant || '-1' as instance, lab, first_seen from primary_map union all select participant || '-2', lab, first_seen from repeat_map)
where instance not in (select record_id || '-' || redcap_repeat_instance from looked where record_id is not null and he_numb_gastric_tile_alg > 0)
group by instance""", "tiles", "slides", extra=COLLATE))
def j7(spark: SparkSession, sf: str) -> DataFrame:
    lists = participant_lists(spark, sf)
    looked = collate.lookup_ids(j2(spark, sf), *lists)
    produced = looked.filter(F.col("record_id").isNotNull() & (F.col("he_numb_gastric_tile_alg") > 0)).select(
        F.concat_ws("-", "record_id", F.col("redcap_repeat_instance").cast("string")).alias("instance"))
    return collate.missing_participants(*lists, produced)


@query("j8_prefix_match", sql("""
select sample_id, min(file_name) as file_name from (select lpad(cast(s_suppkey as varchar), 5, '0') as sample_id from supplier where s_suppkey % 4 <> 0 union all select '0' || cast(s_suppkey as varchar) from supplier) s
join (select distinct lpad(cast(l_suppkey as varchar), 5, '0') || '-' || l_returnflag || l_linestatus || '.csv' as file_name from lineitem) f on starts_with(file_name, sample_id) group by sample_id"""))
def j8(spark: SparkSession, sf: str) -> DataFrame:
    s = proxies.table(spark, sf, "supplier")
    text = F.col("s_suppkey").cast("string")
    samples = s.filter(F.col("s_suppkey") % 4 != 0).select(F.lpad(text, 5, "0").alias("sample_id")).union(
        s.select(F.concat(F.lit("0"), text)))
    files = proxies.table(spark, sf, "lineitem").select(F.concat(
        F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), F.lit("-"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(".csv")
    ).alias("file_name")).distinct()
    return collate.prefix_match(samples, files)


@query("j9_label_join", sql("""
select slide_id, n as positive_tiles, code from (select slide_id, count(*) filter (where score > 0.99) as n from tiles group by slide_id) join truth using (slide_id)""", "tiles", "truth"))
def j9(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.tile_scores(spark, sf)
    return collate.label_join(triage.positive_tiles(tiles, "score", 0.99), proxies.truth_codes(spark, sf))


@query("j10_join_by_stem", sql("""
select replace(slide_name, '.ndpi', '') as stem, count(*) as tiles, max(score) as best from tiles join slides using (slide_id) group by 1""", "tiles", "slides"))
def j10(spark: SparkSession, sf: str) -> DataFrame:
    named = proxies.slides(spark, sf)
    masks = named.select(names.stem(F.concat(F.lit("/masks/"), names.stem(F.col("slide_name")), F.lit(".jpg"))).alias("stem"), "slide_id")
    per_slide = proxies.tile_scores(spark, sf).groupBy("slide_id").agg(F.count(F.lit(1)).alias("tiles"), F.max("score").alias("best"))
    files = per_slide.join(named, "slide_id").withColumn("stem", names.stem(F.concat(F.lit("/patches/"), names.stem(F.col("slide_name")), F.lit(".h5"))))
    return files.drop("slide_id").join(masks, "stem").select("stem", "tiles", "best")


@query("s21_package_case", sql("""
select record_id || '-' || redcap_repeat_instance as instance, coalesce(h_e_slide_filename, '') as f0, coalesce(p53_slide_filename, '') as f1, coalesce(tff3_slide_filename, '') as f2
from looked where record_id is not null and record_id || '-' || redcap_repeat_instance not in
  (select record_id || '-' || redcap_repeat_instance from looked where record_id is not null and he_numb_gastric_tile_alg > 0)""", "tiles", "slides", extra=COLLATE))
def s21(spark: SparkSession, sf: str) -> DataFrame:
    looked = collate.lookup_ids(j2(spark, sf), *participant_lists(spark, sf))
    packaged = looked.filter(F.col("record_id").isNotNull() & (F.col("he_numb_gastric_tile_alg") > 0)).select(
        F.concat_ws("-", "record_id", F.col("redcap_repeat_instance").cast("string")).alias("instance"))
    listed_cases = tables.case_manifest(looked, packaged, ["h_e_slide_filename", "p53_slide_filename", "tff3_slide_filename"])
    return listed_cases.select(
        "instance", *[F.coalesce(F.get("folders", F.lit(i)), F.lit("")).alias(f"f{i}") for i in range(3)])
