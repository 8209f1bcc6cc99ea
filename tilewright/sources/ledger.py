"""Run ledger: what became of each slide in each step of a study.

Rows are only ever added: ``slide_id, step, attempt, status, seconds, at``, one folder per step. The last
attempt of a slide counts, so a run that broke off goes on where it stopped and a run that is complete
does nothing. Outputs are stored before their rows, and the stores take nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Status of a slide whose output is stored, and of one that a later run need not try again.
DONE, EMPTY, FAILED = "processed", "no_output", "failed"
_COLUMNS = "slide_id string, attempt int, status string, seconds double, at timestamp, step string"


def entries(spark: SparkSession, path: str, step: str) -> DataFrame:
    """All rows of a step, none if there is no ledger or the step never ran."""
    try:
        return spark.read.schema(_COLUMNS).parquet(path).filter(F.col("step") == step)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COLUMNS)


def latest(spark: SparkSession, path: str, step: str) -> DataFrame:
    """The last attempt of every slide: ``slide_id, attempt, status, seconds, at``."""
    values = ["attempt", "status", "seconds", "at"]
    newest = entries(spark, path, step).groupBy("slide_id").agg(
        F.max_by(F.struct(*values), F.struct("attempt", "at", "status")).alias("r"))
    return newest.select("slide_id", *[F.col(f"r.{c}").alias(c) for c in values])


def pending(slides: DataFrame, path: str, step: str, retry: bool = True, key: str = "slide_id") -> DataFrame:
    """Rows of ``slides`` that the step still has to do; failed slides come again if ``retry``.

    A slide without an id cannot be told from another and is always pending.
    """
    settled = [DONE, EMPTY] if retry else [DONE, EMPTY, FAILED]
    done = latest(slides.sparkSession, path, step).filter(F.col("status").isin(settled)).select(F.col("slide_id").alias("__done"))
    return slides.join(done, F.col(key).cast("string") == F.col("__done"), "left_anti")


def record(rows: DataFrame, path: str, step: str, seconds: Column | float | None = None, key: str = "slide_id") -> None:
    """Add ``key, status`` of ``rows`` as the next attempt of each slide."""
    before = latest(rows.sparkSession, path, step).select(F.col("slide_id").alias("__s"), F.col("attempt").alias("__a"))
    taken = seconds if isinstance(seconds, Column) else F.lit(seconds)
    named = rows.select(F.col(key).cast("string").alias("slide_id"), "status", taken.cast("double").alias("seconds"))
    numbered = named.join(before, F.col("slide_id") == F.col("__s"), "left")
    numbered.select(
        "slide_id", (F.coalesce("__a", F.lit(0)) + 1).cast("int").alias("attempt"), "status", "seconds",
        F.current_timestamp().alias("at"), F.lit(step).alias("step"),
    ).write.mode("append").partitionBy("step").parquet(path)


def statuses(todo: DataFrame, made: DataFrame, key: str = "slide_id", empty: str = EMPTY) -> DataFrame:
    """``key, status`` of the slides in ``todo``: done where ``made`` has a row, ``empty`` elsewhere."""
    found = made.select(F.col(key).alias("__m")).distinct()
    joined = todo.select(key).distinct().join(found, F.col(key) == F.col("__m"), "left")
    return joined.select(key, F.when(F.col("__m").isNotNull(), DONE).otherwise(empty).alias("status"))
