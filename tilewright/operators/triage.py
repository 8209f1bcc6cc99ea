"""Per-slide positive counts, triage results and the records built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import config
from tilewright.functions import names
from tilewright.operators.ordering import row_index, top_rows


def positive_tiles(tiles: DataFrame, score: str, threshold: float | Column, slide: str = "slide_id") -> DataFrame:
    """Tiles strictly above the threshold per slide; slides without any keep a zero."""
    return tiles.groupBy(slide).agg(F.count_if(F.col(score) > threshold).alias("positive_tiles"))


def triage(counts: DataFrame, lcp: int | Column, hcp: int | Column) -> DataFrame:
    """3 from ``hcp`` tiles on, 2 strictly between the cut-offs, 1 otherwise."""
    n = F.col("positive_tiles")
    result = F.when(n >= hcp, 3).when((n < hcp) & (n > lcp), 2).otherwise(1)
    return counts.withColumn("algorithm_result", result)


def triage_for_stain(tiles: DataFrame, stain: str, score: str | None = None, slide: str = "slide_id") -> DataFrame:
    s = config.settings(stain)
    counts = positive_tiles(tiles, score or s["ranked_class"], s["threshold"], slide)
    return triage(counts, s["lcp"], s["hcp"])


def _ranking(score: str, ties: tuple[str, ...]) -> list[Column]:
    return [F.col(score).desc(), *[F.col(c) for c in ties]]


def positives_ordered(
    tiles: DataFrame,
    score: str,
    threshold: float,
    slide: str = "slide_id",
    ties: tuple[str, ...] = ("x_min", "y_min", "tile_id"),
) -> DataFrame:
    """Tiles above the threshold with their one-based place per slide, best first."""
    kept = tiles.filter(F.col(score) > threshold)
    placed = row_index(kept, [slide], _ranking(score, ties), "place")
    return placed.withColumn("place", F.col("place") + 1)


def top_crops(
    tiles: DataFrame,
    score: str,
    threshold: float,
    k: int = 5,
    slide: str = "slide_id",
    zoom: int = 2,
    ties: tuple[str, ...] = ("x_min", "y_min", "tile_id"),
) -> DataFrame:
    """The best ``k`` positive tiles per slide with their zoomed crop boxes."""
    best = top_rows(tiles.filter(F.col(score) > threshold), [slide], _ranking(score, ties), k)
    return crop_box(best, zoom)


def crop_box(tiles: DataFrame, zoom: int = 2) -> DataFrame:
    """Grow each box ``zoom`` times about its centre with floor division."""
    w = F.col("x_max") - F.col("x_min")
    h = F.col("y_max") - F.col("y_min")
    return tiles.withColumns({
        "crop_x": F.col("x_min") - F.floor(w * (zoom - 1) / 2).cast("bigint"),
        "crop_y": F.col("y_min") - F.floor(h * (zoom - 1) / 2).cast("bigint"),
        "crop_w": w * zoom,
        "crop_h": h * zoom,
    })


def annotation_name(stem: Column, slide_name: Column, version: Column, formats: tuple[str, ...]) -> Column:
    """The annotation file recorded for a slide: GeoJSON before NDPA before XML."""
    if "json" in formats:
        return F.concat(version, F.lit(".geojson"))
    if "ndpa" in formats:
        return F.concat(slide_name, F.lit(".ndpa"))
    if "xml" in formats:
        return F.concat(version, F.lit(".xml"))
    return F.lit(None).cast("string")


def slide_records(
    results: DataFrame,
    slides: DataFrame,
    version: str,
    formats: tuple[str, ...] = (),
    slide: str = "slide_id",
    name: str = "slide_name",
    sample: str = "sample_id",
) -> DataFrame:
    """One run-result row per slide; slides without positive tiles have no annotation file."""
    joined = results.join(slides.select(slide, name), slide)
    stem = names.stem(F.col(name))
    mapped = annotation_name(stem, F.col(name), F.lit(version), formats)
    return joined.select(
        names.name_token(F.col(name), 0).alias(sample),
        stem.alias("slide_filename"),
        "positive_tiles",
        "algorithm_result",
        F.when(F.col("positive_tiles") > 0, mapped).alias("tile_mapping"),
        F.lit(version).alias("algorithm_version"),
    )


def run_tally(records: DataFrame) -> DataFrame:
    r = F.col("algorithm_result")
    return records.agg(
        F.count_if(r == 3).alias("high"), F.count_if(r == 2).alias("low"), F.count_if(r == 1).alias("negative")
    )


def stage_means(log: DataFrame, stages: tuple[str, ...] = ("seg", "patch", "stitch")) -> DataFrame:
    """Mean seconds per stage; a stage that did not run counts as -1."""
    return log.agg(*[F.avg(F.coalesce(F.col(s), F.lit(-1.0))).alias(f"{s}_mean") for s in stages])
