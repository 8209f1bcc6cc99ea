"""Feature vectors: range scaling, exact cosine neighbours, and approximate ones by inverted cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tilewright.operators.ordering import join_null_safe, top_rows
from tilewright.session import materialise


def min_max_scale(df: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """(x - min) / (max - min) over the table or per key; null where all values are equal."""
    limits = [F.min(column).alias("__lo"), F.max(column).alias("__hi")]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*limits), keys)
    else:
        span = df.agg(*limits).select(F.struct("__lo", "__hi").alias("s")).scalar()
        joined = df.withColumn("__s", span).withColumns({"__lo": F.col("__s.__lo"), "__hi": F.col("__s.__hi")}).drop("__s")
    lo, hi = F.col("__lo"), F.col("__hi")
    return joined.withColumn(name, F.try_divide(F.col(column) - lo, hi - lo)).drop("__lo", "__hi")


_FOUND = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column at length one; a zero vector stays zero."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms == 0, 1.0, norms)


#: Similarities that are held at once: 8 MB, however long the blocks are.
STRIP_CELLS = 1 << 20


def _best(lhs: pa.Table, rhs: pa.Table, k: int) -> pa.Table:
    """The ``k`` most similar rows of ``rhs`` for each row of ``lhs``, strip by strip."""
    if not lhs.num_rows or not rhs.num_rows:
        return _FOUND.empty_table()
    rhs = rhs.sort_by("id")
    a, b = lhs.column("id").to_numpy(), rhs.column("id").to_numpy()
    lvec, rvec = _unit(lhs.column("v")), _unit(rhs.column("v"))
    keep = min(k, len(b))
    strip = max(1, STRIP_CELLS // len(b))
    found = []
    for at in range(0, len(a), strip):
        ids = a[at:at + strip]
        sims = lvec[at:at + strip] @ rvec.T
        # A vector with a non-finite component has no similarity to any other.
        sims[(ids[:, None] == b[None, :]) | ~np.isfinite(sims)] = -np.inf
        least = np.partition(sims, len(b) - keep, axis=1)[:, len(b) - keep]
        row, col = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
        value = sims[row, col]
        # Columns are in id order, so ties go to the smaller id whatever the block layout.
        order = np.lexsort((col, -value, row))
        first = np.searchsorted(row, np.arange(len(ids)))
        order = order[np.arange(len(row)) - first[row] < keep]
        found.append(pa.Table.from_arrays([pa.array(ids[row[order]]), pa.array(b[col[order]]), pa.array(value[order])], schema=_FOUND))
    return pa.concat_tables(found)


_FOUND_SQL = "id bigint, neighbour bigint, similarity double"


def _ranked(found: DataFrame, k: int, ident: str) -> DataFrame:
    ranked = top_rows(found, ["id"], [F.col("similarity").desc(), F.col("neighbour")], k)
    return ranked.select(F.col("id").alias(ident), "neighbour", "similarity", "rank")


def cosine_neighbours(
    features: DataFrame, k: int, ident: str = "tile_id", vector: str = "features", block_rows: int = 16384, keys: list[str] | None = None
) -> DataFrame:
    """The ``k`` most similar other rows of each row, exactly: ``ident, neighbour, similarity, rank``.

    Rows are hashed to blocks of about ``block_rows``; every pair of blocks is compared in strips
    of matrix products that keep the ``k`` best per row, so a task holds two blocks and one strip,
    and of all pairs only the ``k`` best per row and block are emitted. Copies spread over the
    blocks like any other row. With ``keys``, such as a study, rows meet only within equal keys; ``ident``
    is unique over all. A vector with a non-finite component is no neighbour and has none. Counts the
    rows once to size the blocks.
    """
    blocks = max(1, math.ceil(features.count() / block_rows))
    keyed = features.select(
        *[F.col(c).alias(f"__key_{c}") for c in keys or []], F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"),
        F.pmod(F.xxhash64(F.col(ident)), F.lit(blocks)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    task = [*[f"__key_{c}" for c in keys or []], "a", "b"]
    left = keyed.withColumnRenamed("own", "a").withColumn("b", every)
    right = keyed.withColumnRenamed("own", "b").withColumn("a", every)
    partial = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(lambda x, y: _best(x, y, k), _FOUND_SQL)
    return _ranked(partial, k, ident)


def cell_centres(features: DataFrame, vector: str, cells: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` cells on the unit sphere, by k-means on at most ``sample`` rows drawn by hash."""
    rows = features.filter(F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    drawn = _unit(rows.select(F.col(vector).alias("v")).orderBy(F.xxhash64(F.col("v"))).limit(sample).toArrow().column("v"))
    centres = np.unique(drawn, axis=0)[np.random.default_rng(0).permutation(len(np.unique(drawn, axis=0)))[:cells]]
    for _ in range(rounds):
        near = np.argmax(drawn @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, drawn)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


def approximate_neighbours(
    features: DataFrame, k: int, ident: str = "tile_id", vector: str = "features", keys: list[str] | None = None,
    cells: int | None = None, probes: int = 8, sample: int = 8192, block_rows: int = 8192,
) -> DataFrame:
    """As ``cosine_neighbours``, from inverted cells: a row meets the members of the ``probes`` cells nearest to it.

    The cells (by default the square root of the rows, 1,024 at most) come from a bounded sample; every
    row is in the cell of its nearest centre. A cell is cut into blocks of about ``block_rows`` rows, so a
    task holds a block of members and one of askers, whatever share of the rows a cell has. Found
    similarities are exact, neighbours in cells that are not probed are missed: measure the recall against
    ``cosine_neighbours`` on a part of the rows, and raise ``probes`` if it is too low.
    """
    n = features.count()
    if not n:
        return cosine_neighbours(features, k, ident, vector, keys=keys)
    centres = cell_centres(features, vector, cells or min(1024, math.ceil(math.sqrt(n))), sample)
    probes = min(probes, len(centres))
    named = features.select(
        *[F.col(c).alias(f"__key_{c}") for c in keys or []], F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"))

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            sims = _unit(pa.chunked_array([batch.column("v")])) @ centres.T
            nearest = np.argsort(-np.nan_to_num(sims, nan=-np.inf), axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, nearest.size + 1, probes), pa.array(nearest.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    schema = T.StructType([*named.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
    placed = materialise(named.mapInArrow(place, schema), "cells")
    part = [f"__key_{c}" for c in keys or []] + ["cell"]
    members = placed.select(*[c for c in placed.columns if c != "near"], F.get("near", F.lit(0)).alias("cell"))
    askers = placed.select(*[c for c in placed.columns if c != "near"], F.explode("near").alias("cell"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    sizes = materialise(join_null_safe(blocks(members, "m_blocks"), blocks(askers, "a_blocks"), part), "cell-blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        sized = join_null_safe(rows, sizes, part)
        return sized.withColumn(own[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(
            other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*part, "a", "m", "id", "v")

    task = [*part, "a", "m"]
    ours, theirs = dealt(askers, "a_blocks", "m_blocks"), dealt(members, "m_blocks", "a_blocks")
    theirs = theirs.select(*[F.col(c).alias(c) for c in theirs.columns])  # both come from one table
    found = ours.groupBy(*task).cogroup(theirs.groupBy(*task)).applyInArrow(lambda x, y: _best(x, y, k), _FOUND_SQL)
    return _ranked(found, k, ident)
