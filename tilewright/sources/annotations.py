"""Annotation documents as ordered text lines, COCO tables, and contour readers.

A document is never built in one value: every tile is one line, ``(slide, line_no, line)``, and
``write_lines`` stores the lines of a slide in order, over as many part files as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilewright.operators.triage import positives_ordered

_KEYS = ("x_min", "y_min", "tile_id")


def _document(placed: DataFrame, line: Column, head: str, tail: str, slide: str) -> DataFrame:
    """Header as line 0, tiles by place, footer after the last; only slides with tiles have one."""
    body = placed.select(slide, F.col("place").alias("line_no"), line.alias("line"))
    ends = placed.groupBy(slide).agg(F.max("place").alias("last")).select(
        slide,
        F.inline(F.array(
            F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(head).alias("line")),
            F.struct((F.col("last") + 1).alias("line_no"), F.lit(tail).alias("line")),
        )),
    )
    return body.unionByName(ends)


def plain_number(value: Column) -> Column:
    """Decimal text of a number, without an exponent where it has up to eighteen decimal places."""
    text = value.cast("string")
    fixed = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.when(text.contains("E"), F.regexp_replace(fixed, r"\.$", ".0")).otherwise(text)


def write_lines(lines: DataFrame, path: str, slide: str = "slide_id") -> None:
    """One folder per slide; its part files, in name order, hold the document. A slide's folder is replaced."""
    ordered = lines.repartitionByRange(F.col(slide), F.col("line_no")).sortWithinPartitions(slide, "line_no")
    ordered.select(slide, "line").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(slide).text(path)


def geojson(tiles: DataFrame, score: str, threshold: float, class_name: str, slide: str = "slide_id") -> DataFrame:
    """A FeatureCollection per slide, best tile first, one closed ring per tile."""
    placed = positives_ordered(tiles, score, threshold, slide, _KEYS)

    def point(x: str, y: str) -> Column:
        return F.array(F.col(x), F.col(y))

    ring = F.array(
        point("x_min", "y_min"), point("x_max", "y_min"), point("x_max", "y_max"), point("x_min", "y_max"),
        point("x_min", "y_min"),
    )
    name = F.concat_ws(
        "_", F.lit(class_name), plain_number(F.round(F.col(score), 4)),
        F.col("x_min").cast("string"), F.col("y_min").cast("string"),
    )
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.lit("PathDetectionObject").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(
            F.lit("annotation").alias("objectType"),
            name.alias("name"),
            F.struct(
                F.lit(class_name).alias("name"), F.array(F.lit(0), F.lit(0), F.lit(255)).alias("color")
            ).alias("classification"),
        ).alias("properties"),
    ))
    line = F.when(F.col("place") > 1, F.concat(F.lit(","), feature)).otherwise(feature)
    return _document(placed, line, '{"type":"FeatureCollection","features":[', "]}", slide)


def asap_xml(tiles: DataFrame, score: str, threshold: float, class_name: str, slide: str = "slide_id") -> DataFrame:
    """A polygon annotation with four ordered corners per tile; the group element closes the file."""
    placed = positives_ordered(tiles, score, threshold, slide, _KEYS)
    corners = [("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max")]
    pattern = (
        '<Annotation Name="%s_%s" Type="Polygon" PartOfGroup="%s" Color="#F4FA58"><Coordinates>'
        + "".join(f'<Coordinate Order="{i}" X="%d" Y="%d" />' for i in range(4))
        + "</Coordinates></Annotation>"
    )
    line = F.format_string(
        pattern, F.lit(class_name), plain_number(F.col(score)), F.lit(class_name),
        *[F.col(c) for pair in corners for c in pair],
    )
    tail = (
        f'</Annotations><AnnotationGroups><Group Name="{class_name}" PartOfGroup="None" Color="#64FE2E">'
        "<Attributes /></Group></AnnotationGroups></ASAP_Annotations>"
    )
    return _document(placed, line, '<?xml version="1.0"?><ASAP_Annotations><Annotations>', tail, slide)


def nanometre_columns(tiles: DataFrame, pyramid: DataFrame, slide: str = "slide_id") -> DataFrame:
    """Viewer coordinates in nanometres: the four corners and the mean corner of each tile."""
    props = F.col("properties")

    def number(key: str, kind: str = "double") -> Column:
        return F.try_element_at(props, F.lit(key)).cast(kind)

    dims = F.get(F.col("levels"), F.lit(0))
    factors = pyramid.select(
        slide,
        (number("openslide.mpp-x") * 1000).alias("__fx"),
        (number("openslide.mpp-y") * 1000).alias("__fy"),
        dims["w"].alias("__w"), dims["h"].alias("__h"),
        number("hamamatsu.XOffsetFromSlideCentre", "bigint").alias("__cx"),
        number("hamamatsu.YOffsetFromSlideCentre", "bigint").alias("__cy"),
    ).select(
        slide, "__fx", "__fy",
        ((F.col("__w") / 2 * F.col("__fx")).cast("bigint") - F.col("__cx")).alias("x_offset"),
        ((F.col("__h") / 2 * F.col("__fy")).cast("bigint") - F.col("__cy")).alias("y_offset"),
    )
    fx, fy = F.col("__fx"), F.col("__fy")

    def to_nm(pixel: Column, factor: Column, offset: str) -> Column:
        return (pixel * factor - F.col(offset)).cast("bigint")

    return tiles.join(factors, slide).withColumns({
        "nm_x_min": to_nm(F.col("x_min"), fx, "x_offset"),
        "nm_y_min": to_nm(F.col("y_min"), fy, "y_offset"),
        "nm_x_max": to_nm(F.col("x_max"), fx, "x_offset"),
        "nm_y_max": to_nm(F.col("y_max"), fy, "y_offset"),
        "x_mean": ((F.col("x_min") + F.col("x_max")) * 2 * fx / 4).cast("bigint"),
        "y_mean": ((F.col("y_min") + F.col("y_max")) * 2 * fy / 4).cast("bigint"),
    }).drop("__fx", "__fy")


def ndpa(
    tiles: DataFrame, pyramid: DataFrame, score: str, threshold: float, class_name: str,
    slide: str = "slide_id", index: str = "tile_id",
) -> DataFrame:
    """A view state with a closed rectangle per tile; slides in other formats than ndpi are left out."""
    kept = pyramid.filter(F.col("slide_name").endswith(".ndpi")).drop("slide_name")
    placed = nanometre_columns(positives_ordered(tiles, score, threshold, slide, _KEYS), kept, slide)
    number = (F.col(index) + 1).cast("string")

    def tag(name: str, value: Column | str) -> Column:
        text = F.lit(value) if isinstance(value, str) else value.cast("string")
        return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))

    corners = [("nm_x_min", "nm_y_min"), ("nm_x_max", "nm_y_min"), ("nm_x_max", "nm_y_max"), ("nm_x_min", "nm_y_max")]
    points = F.concat(*[
        F.concat(F.lit("<point>"), tag("x", F.col(x)), tag("y", F.col(y)), F.lit("</point>")) for x, y in corners
    ])
    line = F.concat(
        F.lit('<ndpviewstate id="'), number, F.lit('">'),
        tag("title", class_name), tag("details", F.concat(F.lit("These are the details of Annotation "), number)),
        tag("coordformat", "nanometers"), tag("lens", "3.628447"),
        tag("x", F.col("x_mean")), tag("y", F.col("y_mean")), tag("z", "0"),
        tag("showtitle", "1"), tag("showhistogram", "0"), tag("showlineprofile", "0"),
        F.lit('<annotation type="freehand" displayname="AnnotateRectangle" color="#00ff00">'),
        tag("measuretype", "0"), tag("closed", "1"),
        F.lit("<pointlist>"), points, F.lit("</pointlist>"), tag("specialtype", "rectangle"),
        F.lit("</annotation></ndpviewstate>"),
    )
    return _document(placed, line, '<?xml version="1.0" encoding="utf-8"?><annotations>', "</annotations>", slide)


# COCO categories.
CATEGORIES = [(1, "Tissue"), (2, "Exclusion")]


def coco_images(boxes: DataFrame) -> DataFrame:
    return boxes.select(
        F.col("image_id").alias("id"), F.col("width").cast("double").alias("width"),
        F.col("height").cast("double").alias("height"), "file_name",
    ).distinct()


def coco_annotations(boxes: DataFrame) -> DataFrame:
    """Normalised boxes; ids are 2i - 1 for the left box and 2i for the right one."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    bbox = F.array(F.col("x") / w, F.col("y") / h, F.col("w") / w, F.col("h") / h)
    return boxes.select(
        (F.col("image_id") * 2 - F.when(F.col("side") == "left", 1).otherwise(0)).alias("id"),
        F.lit(1).alias("category_id"), "image_id", bbox.alias("bbox"),
        (F.col("w") / w * (F.col("h") / h)).alias("area"),
    )


def coco_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "id int, name string")


def merge_coco(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Concatenate the images and the annotations; the categories stay fixed."""
    images, annotations = parts[0]
    for more_images, more_annotations in parts[1:]:
        images, annotations = images.unionByName(more_images), annotations.unionByName(more_annotations)
    return images, annotations


XML_SCHEMA = (
    "_Name string, Coordinates struct<Coordinate: array<struct<_Order: int, _X: double, _Y: double>>>"
)


def contours_from_xml(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """``path, points`` per annotation, coordinates truncated to integers; rank them with G7."""
    rows = spark.read.format("xml").option("rowTag", "Annotation").schema(XML_SCHEMA).load(path)
    corners = F.col("Coordinates.Coordinate")
    points = F.transform(
        corners, lambda c: F.struct(c["_X"].cast("bigint").alias("x"), c["_Y"].cast("bigint").alias("y"))
    )
    return rows.select(*(keep or []), F.input_file_name().alias("path"), points.alias("points"))


POLYGON_TEXT = "array<struct<type: string, coordinates: string>>"


def contours_from_text(texts: DataFrame, text: str = "text", slide: str = "slide_id") -> DataFrame:
    """Contours of a geometry text: a Polygon gives one per ring, other types join their segments.

    The text is parsed as JSON and never evaluated.
    """
    groups = texts.select(slide, F.posexplode(F.from_json(F.col(text), POLYGON_TEXT)).alias("group_idx", "g"))
    rings = F.from_json(F.col("g.coordinates"), "array<array<array<double>>>")
    joined = F.transform(
        F.from_json(F.col("g.coordinates"), "array<array<array<array<double>>>>"), lambda segments: F.flatten(segments)
    )
    chosen = F.when(F.col("g.type") == "Polygon", rings).otherwise(joined)
    return groups.select(slide, "group_idx", F.posexplode(chosen).alias("ring_idx", "ring")).select(
        slide, "group_idx", "ring_idx",
        F.transform("ring", lambda p: F.struct(
            F.get(p, F.lit(0)).cast("bigint").alias("x"), F.get(p, F.lit(1)).cast("bigint").alias("y")
        )).alias("points"),
    )
