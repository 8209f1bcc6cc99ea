"""Table-shaped sources and sinks: process lists, predictions, coordinates, bags and results."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tilewright import config
from tilewright.functions import names
from tilewright.session import shared_folder

SLIDE_EXTENSIONS = ("ndpi", "svs")
#: Folders over which a store spreads its slides, by hash, and the column that names them.
BUCKETS, BUCKET = 64, "slide_bucket"


def list_slides(spark: SparkSession, folder: str, extensions: tuple[str, ...] = SLIDE_EXTENSIONS) -> DataFrame:
    """Slide files of a folder as ``slide_id, path, length``; contents are never read."""
    reader = spark.read.format("binaryFile")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    return reader.load(folder).select(names.basename(F.col("path")).alias("slide_id"), "path", "length").orderBy("slide_id")


def slide_files(files: DataFrame, extensions: tuple[str, ...] = SLIDE_EXTENSIONS, path: str = "path") -> DataFrame:
    """The slides among listed files as ``slide_id, path``, in name order."""
    extension = F.lower(F.substring_index(F.col(path), ".", -1))
    kept = files.filter(extension.isin(*extensions)) if extensions else files
    return kept.select(names.basename(F.col(path)).alias("slide_id"), F.col(path).alias("path")).orderBy("slide_id")


def read_process_list(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``.txt``: one slide per line; ``.csv``: a header with ``slide_id``."""
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.trim("value").alias("slide_id"))
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError("a process list is a .txt or .csv file")


def apply_preset(params: DataFrame, preset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Row values of the first preset row replace the parameters of every slide."""
    keys = keys or [c for c in config.SLIDE_DEFAULTS if c in preset.columns]
    row = preset.limit(1).select(F.struct(*keys).alias("p")).scalar()
    with_row = params.withColumn("__p", row)
    return with_row.withColumns({
        k: F.coalesce(F.col(f"__p.{k}").cast(config.SLIDE_TYPES.get(k, "string")),
                      F.col(k) if k in params.columns else F.lit(None))
        for k in keys
    }).drop("__p")


def init_process_list(
    slides: DataFrame,
    params: dict | None = None,
    heatmap: bool = False,
    patches: bool = False,
) -> DataFrame:
    """Keep given values, fill nulls with defaults and add the columns that are missing."""
    values = {**config.SLIDE_DEFAULTS, **(params or {})}
    defaults: dict[str, Column] = {"process": F.lit(1).cast("smallint"), "status": F.lit("tbp")}
    defaults |= {k: F.lit(values[k]).cast(t) for k, t in config.SLIDE_TYPES.items()}
    if heatmap:
        defaults["label"] = F.lit(-1)
        defaults |= {k: F.lit(None).cast("double") for k in ("x1", "x2", "y1", "y2")}
    if patches:
        defaults["white_thresh"] = F.lit(values.get("white_thresh", 15)).cast("smallint")
        defaults["black_thresh"] = F.lit(values.get("black_thresh", 50)).cast("smallint")
    return slides.withColumns({
        k: F.coalesce(F.col(k), d) if k in slides.columns else d for k, d in defaults.items()
    })


def to_process(slides: DataFrame) -> DataFrame:
    return slides.filter(F.col("process") == 1)


def skip_existing(slides: DataFrame, done: DataFrame, key: str = "slide_id") -> DataFrame:
    """Slides with an output get ``already_exist`` and ``process`` 0; the others are untouched."""
    seen = done.select(F.col(key).alias("__k")).distinct().withColumn("__seen", F.lit(True))
    joined = slides.join(seen, F.col(key) == F.col("__k"), "left")
    hit = F.coalesce(F.col("__seen"), F.lit(False))
    return joined.withColumns({
        "status": F.when(hit, "already_exist").otherwise(F.col("status")),
        "process": F.when(hit, F.lit(0).cast("smallint")).otherwise(F.col("process")),
    }).drop("__k", "__seen")


def missing_files(wanted: DataFrame, found: DataFrame, key: str = "slide_id") -> DataFrame:
    return wanted.join(found.select(key), key, "left_anti")


def present_files(wanted: DataFrame, found: DataFrame, key: str = "slide_id") -> DataFrame:
    return wanted.join(found.select(key), key, "left_semi")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, label: str, mode: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """Write to a fresh folder of the shared store and read back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(*(partition_by or []))
    if mode == "csv":
        writer = writer.option("header", True)
    writer.format(mode).save(path)
    reader = spark.read.schema(df.schema)
    if mode == "csv":
        reader = reader.option("header", True)
    return reader.format(mode).load(path).select(*df.columns)


def bucketed(df: DataFrame, buckets: int = BUCKETS, key: str = "slide_id") -> DataFrame:
    """``df`` with the folder of each slide; slides without an id share one."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def touched(stored: DataFrame, df: DataFrame, folders: list[str]) -> DataFrame:
    """The part of a partitioned table that lies in the folders of ``df``, as a filter that prunes the scan.

    The folders of ``df`` come to the driver: a bucket for each stain and version at most.
    """
    here = df.select(*folders).distinct().collect()
    if not here:
        return stored.limit(0)
    wanted = F.lit(True)
    for c in folders:
        values = {r[c] for r in here}
        known = F.col(c).isin(sorted(values - {None}))
        wanted = wanted & (known | F.col(c).isNull() if None in values else known)
    return stored.filter(wanted)


def not_stored(
    df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", folders: list[str] | None = None, within: DataFrame | None = None
) -> DataFrame:
    """Rows whose keys the table at ``path`` does not hold yet; all rows while there is no table.

    Null keys are equal. Where ``folders`` names the table's partition columns, only the folders that
    ``df`` falls into are read; ``within``, if given, tells them without computing ``df`` for it.
    """
    reader = df.sparkSession.read
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        stored = reader.schema(df.schema).format(fmt).load(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return df
    if folders:
        stored = touched(stored, df if within is None else within, folders)
    held = stored.select(*[F.col(k).alias(f"__k_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(held, same, "left_anti").select(*df.columns)


def _append(rows: DataFrame, path: str, folders: list[str], fmt: str = "parquet") -> None:
    """Add rows to their folders. Small folders share a task and a large one is split."""
    writer = rows.hint("rebalance", *folders).write.mode("append").partitionBy(*folders)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", slides: DataFrame | None = None) -> None:
    """Store per-tile predictions, one folder per stain, model version and bucket of slides.

    Slides that have predictions of the stain and version are left as they are, so a repeated run adds
    nothing. A run reads the folders it writes to, whatever else is stored. ``slides`` may list the
    ``stain, model_ver, slide_id`` in ``df``, so that scores need not be computed to know the folders.
    """
    folders = ["stain", "model_ver", BUCKET]
    within = None if slides is None else bucketed(slides)
    rows = not_stored(bucketed(df), path, ["stain", "model_ver", "slide_id"], fmt, folders, within)
    _append(rows, path, folders, fmt)


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).drop(BUCKET)


def append_coords(tiles: DataFrame, tile_sets: DataFrame, path: str) -> None:
    """Store the tiles that are not stored yet, and before them the attributes of new slides.

    Both lie in buckets of slides; a run reads the buckets of its own slides.
    """
    for rows, name, keys in ((tile_sets, "tile_sets", ["slide_id"]), (tiles, "tiles", ["slide_id", "x", "y"])):
        _append(not_stored(bucketed(rows), f"{path}/{name}", keys, folders=[BUCKET]), f"{path}/{name}", [BUCKET])


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    tiles = spark.read.parquet(f"{path}/tiles").drop(BUCKET)
    return with_attributes(tiles, spark.read.parquet(f"{path}/tile_sets").drop(BUCKET))


def with_attributes(tiles: DataFrame, tile_sets: DataFrame) -> DataFrame:
    """Attach the attributes of each slide; the optimiser broadcasts them where they are small."""
    return tiles.join(tile_sets, "slide_id")


def append_bag(patches: DataFrame, path: str) -> None:
    """Store the ``slide_id, x, y, img`` rows that are not stored yet; ``img`` is an opaque binary payload."""
    rows = patches.select("slide_id", "x", "y", F.col("img").cast("binary").alias("img"))
    _append(not_stored(bucketed(rows), path, ["slide_id", "x", "y"], folders=[BUCKET]), path, [BUCKET])


def column_groups(df: DataFrame, groups: dict[str, str | list[str]], keep: list[str] | None = None) -> DataFrame:
    """Pack named columns into one field each: a single column as it is, several as an array."""
    packed = [
        F.col(spec).alias(name) if isinstance(spec, str) else F.array(*[F.col(c) for c in spec]).alias(name)
        for name, spec in groups.items()
    ]
    return df.select(*(keep or []), *packed)


def with_run_date(records: DataFrame, date: Column | None = None, pattern: str = "yyMMdd") -> DataFrame:
    return records.withColumn("run_date", F.date_format(date if date is not None else F.current_date(), pattern))


def write_results(records: DataFrame, path: str, stain: str, date: Column | None = None) -> None:
    """Write a run under its stain and date in place of an earlier run of that day; other folders stay."""
    with_run_date(records, date).withColumn("stain", F.lit(stain)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("stain", "run_date").parquet(path)


def labelled_tiles(paths: DataFrame, cases: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Files laid out as case/class/tile, limited to the given cases and classes."""
    parts = F.split("path", "/", -1)
    n = F.size(parts)
    laid_out = paths.select(
        "path", F.get(parts, n - 3).alias("case"), F.get(parts, n - 2).alias("tile_class"), F.get(parts, n - 1).alias("tile")
    )
    wanted = cases.select(names.case_name(F.col("case")).alias("case")).distinct()
    kept = laid_out.join(wanted, "case", "left_semi")
    return kept.filter(F.col("tile_class").isin(classes)) if classes else kept


def case_manifest(crf: DataFrame, packaged: DataFrame, slide_columns: list[str]) -> DataFrame:
    """``instance, folders`` for participants that are not packaged yet."""
    instance = F.concat_ws("-", F.col("record_id"), F.col("redcap_repeat_instance").cast("string"))
    listed = crf.filter(F.col("record_id").isNotNull()).select(
        instance.alias("instance"), F.array(*[F.col(c) for c in slide_columns]).alias("folders")
    )
    return listed.join(packaged.select("instance"), "instance", "left_anti")
