"""Running triage over arriving prediction files.

The checkpoint remembers which files were read, so a restart neither skips nor repeats one. Every
micro-batch merges the totals of the slides it touched into the current table, which has one row per
slide and model however many batches there were. The table lies in two places in turn, each with a
pointer that is written last: a reader follows the newer pointer, a batch that broke off left the other
place alone, and its repetition starts from there again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators.triage import triage


def prediction_stream(spark: SparkSession, folder: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def running_triage(
    tiles: DataFrame, score: str, threshold: float, lcp: int, hcp: int, keys: tuple[str, ...] = ("slide_id", "model_ver"),
    once: tuple[str, ...] = (),
) -> DataFrame:
    """State per slide and model is one count.

    ``once`` names what tells the tiles of a slide apart. With it, a tile that arrives again, as in a file
    copied under another name, counts once; the state then also holds a key per tile.
    """
    counted = tiles.dropDuplicates([*keys, *once]) if once else tiles
    counts = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col(score) > threshold).alias("positive_tiles"))
    return triage(counts, lcp, hcp)


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """``batch_id, place`` of the tables that are complete, the newest first."""
    out = []
    for place in (0, 1):
        try:
            row = spark.read.schema("batch_id bigint").parquet(f"{path}/pointer_{place}").first()
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if row is not None:
            out.append((row.batch_id, place))
    return sorted(out, reverse=True)


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: tuple[str, ...] = ("slide_id", "model_ver")) -> None:
    """Replace the rows of the slides in ``batch`` in the current table; the same batch may come again."""
    spark = batch.sparkSession
    earlier = [place for at, place in _pointers(spark, path) if at < batch_id]
    place = 1 - earlier[0] if earlier else 0
    merged = batch
    if earlier:
        old = spark.read.schema(batch.schema).parquet(f"{path}/table_{earlier[0]}")
        same = F.lit(True)
        fresh = batch.select(*[F.col(k).alias(f"__{k}") for k in keys])
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        merged = old.join(fresh, same, "left_anti").unionByName(batch)
    merged.write.mode("overwrite").parquet(f"{path}/table_{place}")
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id")).write.mode("overwrite").parquet(f"{path}/pointer_{place}")


def start_upserts(
    results: DataFrame, path: str, checkpoint: str, available_now: bool = False, keys: tuple[str, ...] = ("slide_id", "model_ver")
) -> StreamingQuery:
    def upsert(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, keys)

    writer = results.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_results(spark: SparkSession, path: str) -> DataFrame:
    """One row of every slide and model: a single table, however many batches made it."""
    places = _pointers(spark, path)
    if not places:
        raise FileNotFoundError(f"no batch has ended in {path}")
    return spark.read.parquet(f"{path}/table_{places[0][1]}")
