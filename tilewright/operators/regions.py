"""Clusters of regions: what lies within ``max_dist`` of each other belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.operators import runs
from tilewright.operators.components import blocked_components
from tilewright.operators.ordering import row_index, top_rows
from tilewright.session import materialise

KEYS = ["slide_id"]
# Cells per side of a block whose links are contracted in one task.
BLOCK_CELLS = 64


def area_order(regions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Zero-based place by area, largest first; equal areas keep raster order."""
    return row_index(regions, keys, [F.col("area").desc(), F.col("region")], "place")


def cluster_regions(regions: DataFrame, max_dist: float, keys: list[str] = KEYS) -> DataFrame:
    """``regions`` with ``place`` and ``cluster``, numbered by the first member in area order.

    Centroids go to cells whose diagonal is below ``max_dist``, so the members of a cell are one node.
    Two neighbouring cells need one link, and the boxes around their members settle most pairs of
    cells. Cells are contracted by blocks, see ``blocked_components``.
    """
    side = max_dist / 1.4143
    placed = materialise(area_order(regions, keys).withColumns({
        "__r": F.floor(F.col("centroid_row") / side), "__c": F.floor(F.col("centroid_col") / side)}), "placed")
    cell = [*keys, "__r", "__c"]
    points = placed.select(*cell, "place", F.col("centroid_row").alias("y"), F.col("centroid_col").alias("x"))
    cells = points.groupBy(*cell).agg(
        F.min("place").alias("head"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    # Half of the cells within two steps; the other half is met from the other side.
    offsets = F.array(*[
        F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
        for a in range(0, 3) for b in range(-2, 3) if (a, b) > (0, 0)])

    def gap(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(lo) - F.col(other_hi), F.col(other_lo) - F.col(hi))

    def to_box(axis: str, side: str) -> Column:
        value = F.col(axis)
        return F.greatest(F.lit(0.0), F.col(f"{side}_{axis}_lo") - value, value - F.col(f"{side}_{axis}_hi"))

    limit = max_dist * max_dist

    def edges(boxes: DataFrame) -> DataFrame:
        facts = ["head", "y_lo", "y_hi", "x_lo", "x_hi"]
        first = boxes.select(
            *keys, F.inline(offsets), F.col("__r").alias("a_r"), F.col("__c").alias("a_c"),
            *[F.col(c).alias(f"a_{c}") for c in facts],
        ).withColumns({"__r": F.col("a_r") + F.col("a"), "__c": F.col("a_c") + F.col("b")}).drop("a", "b")
        pairs = first.join(boxes.withColumnsRenamed({c: f"b_{c}" for c in facts}), cell)
        wide_y = F.greatest(F.col("a_y_hi") - F.col("b_y_lo"), F.col("b_y_hi") - F.col("a_y_lo"))
        wide_x = F.greatest(F.col("a_x_hi") - F.col("b_x_lo"), F.col("b_x_hi") - F.col("a_x_lo"))
        near_y = gap("a_y_lo", "a_y_hi", "b_y_lo", "b_y_hi")
        near_x = gap("a_x_lo", "a_x_hi", "b_x_lo", "b_x_hi")
        pairs = materialise(
            pairs.filter(near_y * near_y + near_x * near_x <= limit).withColumn(
                "sure", wide_y * wide_y + wide_x * wide_x <= limit), "cell-pairs")
        open_pairs = pairs.filter(~F.col("sure"))

        def reachable(side: str) -> Column:
            return to_box("y", side) * to_box("y", side) + to_box("x", side) * to_box("x", side) <= limit

        # Only pairs of cells that their boxes leave open compare members, and only members that
        # can reach the box of the other cell.
        ours = points.withColumnsRenamed({"__r": "a_r", "__c": "a_c"}).join(open_pairs, [*keys, "a_r", "a_c"]).filter(
            reachable("b")).withColumnsRenamed({"y": "a_y", "x": "a_x"}).drop("place", "b_head", *[f"b_{c}" for c in facts])
        theirs = points.join(boxes.select(*cell, F.col("head").alias("b_head")), cell)
        met = ours.join(theirs, cell).filter(reachable("a"))
        dy, dx = F.col("y") - F.col("a_y"), F.col("x") - F.col("a_x")
        ends = [*keys, "a_head", "b_head", "a_r", "a_c", "__r", "__c"]
        close = met.filter(dy * dy + dx * dx <= limit).select(*ends)

        def block(row: str, col: str) -> Column:
            return F.struct(F.floor(F.col(row) / BLOCK_CELLS).alias("r"), F.floor(F.col(col) / BLOCK_CELLS).alias("c"))

        return pairs.filter("sure").select(*ends).unionByName(close).distinct().select(
            *keys, F.col("a_head").alias("src"), F.col("b_head").alias("dst"),
            F.when(block("a_r", "a_c") == block("__r", "__c"), block("a_r", "a_c")).alias("block"))

    merged = blocked_components(cells, edges, keys, "head", "__first").select(*cell, "__first")
    firsts = merged.select(*keys, "__first").distinct()
    # One row per cluster: the number of earlier clusters is its label.
    labels = row_index(firsts, keys, [F.col("__first")], "cluster")
    named = merged.join(labels, [*keys, "__first"]).select(*cell, "cluster")
    return placed.join(named, cell).drop("__r", "__c")


def filled_area(labelled: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area of each region with its own holes filled; diagonal gaps do not close a hole."""
    inner = [*keys, "region"]
    box = runs.region_properties(labelled, keys).select(*inner, "min_row", "min_col", "max_row", "max_col")
    local = labelled.join(box, inner).select(
        *inner, (F.col("row") - F.col("min_row")).alias("row"), (F.col("start") - F.col("min_col")).alias("start"),
        (F.col("stop") - F.col("min_col")).alias("stop"))
    sizes = box.select(
        *inner, (F.col("max_col") - F.col("min_col")).alias("width"), (F.col("max_row") - F.col("min_row")).alias("height"))
    filled = runs.fill_holes(local, sizes, inner, connectivity=8)
    return filled.groupBy(*inner).agg(F.sum(F.col("stop") - F.col("start") + 1).alias("filled_area"))


def cluster_boxes(clustered: DataFrame, filled: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Union box and filled area per cluster."""
    return clustered.join(filled, [*keys, "region"]).groupBy(*keys, "cluster").agg(
        F.min("min_row").alias("min_row"), F.min("min_col").alias("min_col"), F.max("max_row").alias("max_row"),
        F.max("max_col").alias("max_col"), F.sum("filled_area").alias("filled_area"), F.count(F.lit(1)).alias("members"))


def choose_clusters(clusters: DataFrame, keep: str = "keep_ids", exclude: str = "exclude_ids") -> DataFrame:
    """(keep or all) minus exclude; both columns are integer arrays, ids out of range are ignored."""
    c = F.col("cluster").cast("int")
    kept = (F.size(keep) == 0) | F.array_contains(keep, c)
    return clusters.filter(kept & ~F.array_contains(exclude, c))


def largest_clusters(clusters: DataFrame, n: int = 2, keys: list[str] = KEYS) -> DataFrame:
    return top_rows(clusters, keys, [F.col("filled_area").desc(), F.col("cluster")], n)
