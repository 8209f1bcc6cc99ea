"""The tasks of a study from end to end, each over all its slides at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import config
from tilewright.functions import geometry as geo, labels as codes
from tilewright.operators import calibration, collate, curves, evaluation, pixels, regions, runs, scoring, tiling, triage
from tilewright.session import materialise
from tilewright.sources import ledger, tables


def segment(
    image: DataFrame, sizes: DataFrame, based_on: str = "hed", contrast: float = 1, remove_pens: bool = True,
    min_pixel_count: int = 25, max_dist: float = 250, choices: DataFrame | None = None, invert: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Pixels to tissue: the mask as runs, and the clusters of its regions.

    ``choices`` holds ``slide_id, keep_ids, exclude_ids`` (integer arrays of cluster numbers).
    Labelling and clustering run their rounds when this is called.
    """
    tissue = runs.from_pixels(pixels.foreground(pixels.tissue_mask(image, contrast, based_on=based_on)))
    if remove_pens:
        tissue = pixels.combine(tissue, pixels.pen_marker_runs(image, sizes), sizes)
    grown = runs.drop_small(runs.label_runs(tissue), sizes, min_pixel_count)
    found = runs.label_runs(runs.fill_holes(grown, sizes))
    clustered = regions.cluster_regions(runs.region_properties(found), max_dist)
    if choices is not None:
        clustered = regions.choose_clusters(clustered.join(choices, "slide_id")).drop("keep_ids", "exclude_ids")
    mask = found.join(clustered.select("slide_id", "region", "cluster"), ["slide_id", "region"])
    boxes = regions.cluster_boxes(clustered, regions.filled_area(found))
    plain = mask.select("slide_id", "row", "start", "stop")
    return (runs.complement(plain, sizes) if invert else mask), boxes


def tile(
    contours: DataFrame, pyramid: DataFrame, patch_size: int, step_size: int, patch_level: int = 0,
    test: str | geo.Predicate = "four_pt", holes: DataFrame | None = None, save_path: str = "", **bounds: object,
) -> tuple[DataFrame, DataFrame]:
    """Contours to tile corners and one attribute row per slide that has tiles."""
    tiles = tiling.tile_slides(contours, pyramid, patch_size, step_size, patch_level, test, holes, **bounds)
    sets = tiling.tile_sets(pyramid, patch_size, patch_level, save_path)
    return tiles, sets.join(tiles.select("slide_id"), "slide_id", "left_semi")


def tiles_in_mask(
    mask: DataFrame, boxes: DataFrame, patch_size: int, step_size: int, scale: float, keys: tuple[str, ...] = ("slide_id",)
) -> DataFrame:
    """Tiles of a grid over each box whose centre lies on the mask: ``keys, cluster, x, y`` in full resolution.

    ``mask`` holds runs (``keys, row, start, stop``) and ``boxes`` ``keys, cluster, x_min, y_min, x_max,
    y_max`` at mask level; ``scale`` is the width of a mask pixel. The grid is spread by its columns before its
    rows are made, and a tile meets only the runs of its own image row.
    """
    def steps(low: str, high: str) -> Column:
        start = F.floor(F.col(low) * scale).cast("bigint")
        return F.explode(F.sequence(start, F.greatest(start, F.floor((F.col(high) + 1) * scale).cast("bigint") - 1), F.lit(step_size).cast("bigint")))

    columns = boxes.select(*keys, "cluster", "y_min", "y_max", steps("x_min", "x_max").alias("x")).repartition(*keys, "cluster", "x")
    grid = columns.select(*keys, "cluster", "x", steps("y_min", "y_max").alias("y"))
    half = patch_size / 2
    grid = grid.withColumns({"row": F.floor((F.col("y") + half) / scale).cast("bigint"), "col": F.floor((F.col("x") + half) / scale).cast("bigint")})
    spans = mask.select(*keys, F.col("row").cast("bigint").alias("row"), "start", "stop")
    return grid.join(spans, [*keys, "row"]).filter(F.col("col").between(F.col("start"), F.col("stop"))).select(*keys, "cluster", "x", "y")


def process_list(slides: DataFrame, ledger_path: str, step: str) -> DataFrame:
    """The process list of a step: slides that an earlier run settled are ``already_exist`` and not processed."""
    done = ledger.latest(slides.sparkSession, ledger_path, step).filter(F.col("status").isin(ledger.DONE, ledger.EMPTY))
    named = tables.init_process_list(slides).withColumn("__slide", F.col("slide_id").cast("string"))
    return tables.skip_existing(named, done.select(F.col("slide_id").alias("__slide")), "__slide").drop("__slide")


def tile_run(
    contours: DataFrame, pyramid: DataFrame, slides: DataFrame, store: str, ledger_path: str, patch_size: int, step_size: int,
    step: str = "tile", **options: object,
) -> DataFrame:
    """Tile the slides that no earlier run has tiled, store their coordinates and enter them in the ledger.

    Returns the process list as it was when the run began. A run that breaks off leaves no entry for what
    it did not store; the next one repeats those slides, and the store takes no tile twice.
    """
    listing = materialise(process_list(slides, ledger_path, step), "process-list")
    todo = tables.to_process(listing).select("slide_id")
    if not todo.isEmpty():
        mine = contours.join(todo, "slide_id", "left_semi")
        found = materialise(tiling.tile_slides(mine, pyramid, patch_size, step_size, **options), "tiles")
        sets = tiling.tile_sets(pyramid.join(todo, "slide_id", "left_semi"), patch_size, int(options.get("patch_level", 0)), store)
        tables.append_coords(found, sets.join(found.select("slide_id"), "slide_id", "left_semi"), store)
        stored = slides.sparkSession.read.schema(tables.bucketed(found).schema).parquet(f"{store}/tiles")
        ledger.record(ledger.statuses(todo, tables.touched(stored, tables.bucketed(todo), [tables.BUCKET])), ledger_path, step)
    return listing


def score_run(
    tiles: DataFrame, tile_sets: DataFrame, slides: DataFrame, factory: Callable[[], scoring.Model], stain: str, version: str,
    store: str, ledger_path: str, feature: str = "features", **triage_options: object,
) -> DataFrame:
    """Tiles to triage in one call: score, box, store, enter in the ledger, triage.

    ``tiles`` holds ``slide_id, tile_id, x, y`` and the model's input. Slides that the ledger has for this
    stain and version are not scored again; the triage is over all stored predictions of ``slides``.
    """
    spark = tiles.sparkSession
    step = f"score {stain} {version}"
    listing = materialise(process_list(slides, ledger_path, step), "process-list")
    todo = tables.to_process(listing).select("slide_id")
    classes = config.settings(stain)["classes"]
    mine = tiles.join(todo, "slide_id", "left_semi").join(tile_sets.select("slide_id", "patch_size"), "slide_id")
    boxes = tiling.tile_box(mine, F.col("patch_size")).drop("patch_size")
    scored = scoring.score_tiles(boxes, factory, classes, feature).withColumns({"stain": F.lit(stain), "model_ver": F.lit(version)})
    if not todo.isEmpty():
        tables.write_predictions(scored, store, slides=todo.withColumns({"stain": F.lit(stain), "model_ver": F.lit(version)}))
    read = tables.read_predictions(spark, store, tables.bucketed(scored).schema)
    stored = read.filter((F.col("stain") == stain) & (F.col("model_ver") == version)).join(slides.select("slide_id"), "slide_id", "left_semi")
    if not todo.isEmpty():
        ledger.record(ledger.statuses(todo, stored), ledger_path, step)
    return triage_run(stored, slides, stain, version, **triage_options)


def triage_run(
    predictions: DataFrame, slides: DataFrame, stain: str, version: str, formats: tuple[str, ...] = (),
    ranked_class: str | None = None, threshold: float | None = None, lcp: int | None = None, hcp: int | None = None,
) -> DataFrame:
    """Wide predictions of one stain to slide records; every setting of the stain can be replaced."""
    s = config.settings(stain)
    ranked = s["ranked_class"] if ranked_class is None or stain == "tff3" else ranked_class
    counts = triage.positive_tiles(predictions, ranked, s["threshold"] if threshold is None else threshold)
    results = triage.triage(counts, s["lcp"] if lcp is None else lcp, s["hcp"] if hcp is None else hcp)
    return triage.slide_records(results, slides, version, formats)


def calibrate(
    predictions: DataFrame, labels: DataFrame, score: str, grid: list[float] | None = None, target: float = 0.7
) -> dict[str, DataFrame]:
    """One sweep, stored once, then the tables read off it. ``labels`` holds ``slide_id, label``."""
    swept = materialise(calibration.sweep(predictions, score, grid), "sweep")
    rated = calibration.rates(calibration.confusion(swept, labels))
    scored = swept.join(labels.filter(F.col("label").isNotNull()), "slide_id")
    keys = ["t_idx", "threshold"]
    auc = curves.roc_auc(scored, "positive_tiles", "label", keys)
    auprc = curves.average_precision(scored, "positive_tiles", "label", keys)
    return {
        "rates": rated,
        "best_at_sensitivity": calibration.best_at_sensitivity(rated, target),
        "youden": calibration.youden(rated),
        "auroc": calibration.sweep_auroc(rated),
        "auc": auc,
        "auprc": auprc,
        "f1": calibration.f1_table(scored, keys),
        "best_auc": calibration.best_value(auc, "auc"),
        "best_auprc": calibration.best_value(auprc, "average_precision"),
    }


def threshold_study(
    predictions: DataFrame, truth: DataFrame, score: str, mapping: dict[str, int], sample: str = "sample_id", code: str = "code",
    grid: list[float] | None = None, target: float = 0.7,
) -> dict[str, DataFrame]:
    """Files and pathologists' codes to the tables of ``calibrate``.

    ``predictions`` holds ``file_name`` and scores per tile, ``truth`` a code per sample. A sample goes with the
    first file that its id begins; samples without a file, and codes outside ``mapping``, drop out.
    """
    matched = collate.prefix_match(truth.select(sample), predictions.select("file_name").distinct(), sample)
    tiles = predictions.join(matched, "file_name").withColumn("slide_id", F.col(sample))
    labels = truth.select(F.col(sample).alias("slide_id"), codes.map_label(F.col(code), mapping).alias("label"))
    return calibrate(tiles, labels, score, grid, target)


def evaluate_run(predictions: DataFrame, n_classes: int, probs: str = "p", y: str = "y", y_hat: str = "y_hat") -> dict[str, DataFrame]:
    """All tables of an evaluation from one scan of the predictions, whose counts are stored."""
    counts = materialise(evaluation.evaluation_counts(predictions, probs, y, y_hat), "evaluation")
    return evaluation.evaluation_tables(counts, n_classes)


def report_form(results: dict[str, DataFrame], primary: DataFrame, repeat: DataFrame, fill: bool = False) -> DataFrame:
    """Four stain results and two participant lists to the export table."""
    return collate.export_columns(collate.lookup_ids(collate.collate(results, fill=fill), primary, repeat))
