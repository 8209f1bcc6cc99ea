"""Ordered prefix sums that do not need a whole group in one task.

A plain window puts every row of its group in one task. Where the group is bounded (thresholds,
epochs, pyramid levels) the operators use plain windows; where it grows with the data they use
the functions here: rows are range-partitioned on (keys, order) and stored with the number of their
partition, each partition is summed, and the partition sums, at most one row per key and partition, give
the offset of every partition. Nothing is cached: the stored table keeps offsets and rows on the same
borders, also when an executor is lost, and lies in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.session import materialise, shuffle_width

_CHUNK = "__chunk"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(named, same, how).drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add one inclusive running sum per entry of ``sums`` within ``keys``, in ``order``.

    Rows with equal ``order`` always share a partition. Not lazy: the range-partitioned input is stored,
    since the borders are drawn anew whenever they are computed.
    """
    n = partitions or shuffle_width(df.sparkSession)
    work = {f"__in_{name}": expr for name, expr in sums.items()}
    ranges = df.withColumns(work).repartitionByRange(n, *[F.col(k) for k in keys], *order)
    chunked = materialise(ranges.withColumn(_CHUNK, F.spark_partition_id()), "ranges")
    totals = chunked.groupBy(*keys, _CHUNK).agg(
        *[F.sum(f"__in_{name}").alias(f"__sum_{name}") for name in sums]
    )
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, _CHUNK,
        *[F.coalesce(F.sum(f"__sum_{name}").over(before), F.lit(0)).alias(f"__off_{name}") for name in sums],
    )
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = join_null_safe(chunked, offsets, [*keys, _CHUNK]).withColumns(
        {name: F.sum(f"__in_{name}").over(inside) + F.col(f"__off_{name}") for name in sums}
    )
    return out.drop(_CHUNK, *work, *[f"__off_{name}" for name in sums])


def row_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """Zero-based position of each row within ``keys``; ``order`` should be total."""
    counted = running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
    return counted.withColumn(name, F.col(name) - 1)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their one-based rank.

    Filtering on ``row_number`` lets Spark cut each partition to ``k`` rows per group before the
    shuffle, so a hot group sends at most ``k`` rows per input partition. Spark does so up to a
    configured ``k``; beyond it the rows are indexed by range partitions instead.
    """
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        placed = row_index(df, keys, order, name).withColumn(name, F.col(name) + 1)
        return placed.filter(F.col(name) <= k)
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(w).cast("bigint"))
        .filter(F.col(name) <= k)
    )


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank", total: str = "n_rows") -> DataFrame:
    """Average rank of ``value`` (ties share the mean rank) and how many rows of the group have one.

    A row without a value stays, with a null rank, and is not counted; a null key is a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__ties"))
    ranked = running_totals(counts, keys, [F.col(value)], {"__upto": F.col("__ties")})
    # The last running sum of a group is its size; a group without a value has none.
    sizes = ranked.groupBy(*keys).agg(F.max("__upto").alias(total))
    ranked = ranked.select(*keys, value, (F.col("__upto") - (F.col("__ties") - 1) / 2.0).alias(name))
    joined = join_null_safe(df, ranked, [*keys, value], "left")
    joined = join_null_safe(joined, sizes, keys, "left") if keys else joined.withColumn(total, sizes.scalar())
    return joined.withColumn(total, F.coalesce(total, F.lit(0).cast("bigint")))
