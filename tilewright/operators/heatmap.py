"""Heat-map grids: mean tile score per cell of a pyramid level.

A tile adds to the grid at its four corners only. Running sums along the grid lines that hold corners,
then down the columns, give sum and count of every cell, so rows grow with tiles and cells, not with
how many tiles overlap. Each shuffle is dealt to as many tasks as the tiles need, so a task's share, its
sums and its sorts do not grow with the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.operators.sampling import percentiles, screen_coords
from tilewright.session import shuffle_width

#: Tiles for which a shuffle has one task at least, and tiles too few for a task of their own.
TASK_TILES, LEAST_TILES = 1 << 18, 1 << 15


def task_count(tiles: DataFrame) -> int:
    """Tasks of a shuffle of ``tiles``: the session's width, fewer for few tiles, more for many. Counts the rows."""
    n = tiles.count()
    return max(1, min(shuffle_width(tiles.sparkSession), math.ceil(n / LEAST_TILES)), math.ceil(n / TASK_TILES))


def heat_grid(
    tiles: DataFrame,
    sizes: DataFrame,
    patch_size: int,
    score: str = "score",
    top_left: tuple[int, int] | None = None,
    bottom_right: tuple[int, int] | None = None,
    as_percentiles: bool = False,
    binarize: bool = False,
    thresh: float = 0.5,
    scale: float = 100.0,
) -> DataFrame:
    """``slide_id, cell_x, cell_y, value`` for every covered cell.

    ``sizes`` holds ``slide_id, dx, dy, width, height`` of the shown level. Scores are divided by
    ``scale`` before the threshold; a negative threshold stands for one over the tile count. Counts the
    tiles once to size the tasks.
    """
    df = tiles
    if binarize and thresh < 0:
        counts = tiles.groupBy("slide_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("__cut"))
        df = df.join(counts, "slide_id")
    else:
        df = df.withColumn("__cut", F.lit(thresh if binarize else 0.0))
    shift = (0, 0)
    if top_left is not None and bottom_right is not None:
        df, shift = screen_coords(df, top_left, bottom_right), top_left
    if as_percentiles:
        df = percentiles(df, score, name="__score")
    else:
        df = df.withColumn("__score", F.col(score))
    df = df.join(sizes, "slide_id").withColumn("__score", F.col("__score") / scale)
    sx, sy = F.lit(1.0) / F.col("dx"), F.lit(1.0) / F.col("dy")

    def extent(size: str, factor: Column, axis: int) -> Column:
        if top_left is None or bottom_right is None:
            return F.col(size)
        return (F.lit(bottom_right[axis]) * factor).cast("bigint") - (F.lit(top_left[axis]) * factor).cast("bigint")

    def span(corner: str, factor: Column, size: str, axis: int) -> Column:
        """The cells of a tile on one axis, the end not included."""
        lo = F.ceil((F.col(corner) - shift[axis]) * factor).cast("bigint")
        hi = F.least(lo + F.ceil(F.lit(patch_size) * factor).cast("bigint"), extent(size, factor, axis))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    shown = F.col("__score") >= F.col("__cut")
    value = F.when(shown, F.lit(1.0) if binarize else F.col("__score")).otherwise(F.lit(0.0))
    placed = df.select("slide_id", value.alias("v"), span("x_min", sx, "width", 0).alias("x"), span("y_min", sy, "height", 1).alias("y"))
    sums = cell_sums(placed.filter("x.lo < x.hi and y.lo < y.hi"), task_count(tiles))
    return sums.select("slide_id", "cell_x", "cell_y", (F.bround("mean", 0) if binarize else F.col("mean")).alias("value"))


def cell_sums(placed: DataFrame, tasks: int) -> DataFrame:
    """``slide_id, cell_x, cell_y, mean, n`` of all cells under boxes ``slide_id, x, y, v``; ``x, y`` hold ``lo, hi``.

    Values are summed as whole numbers in two parts, so what is taken off at a box's far side is what was
    added, to the last digit. Rows are dealt to ``tasks`` tasks before they are summed: sums within a split of
    the input would hold all boxes of the split, and adaptive execution would pack small shares together.
    """
    names = ["high", "low", "n"]
    scaled = placed.select("slide_id", "x", "y", (F.col("v") * float(1 << 30)).alias("s"))
    whole = scaled.select(
        "slide_id", "x", "y", F.floor("s").cast("bigint").alias("high"),
        F.round((F.col("s") - F.floor("s")) * float(1 << 40)).cast("bigint").alias("low"), F.lit(1).cast("bigint").alias("n"))

    def corner(line: str, at: str, sign: int) -> Column:
        return F.struct(F.col(f"y.{line}").alias("line"), F.col(f"x.{at}").alias("at"), *[(sign * F.col(n)).alias(n) for n in names])

    # Boxes at one place become one, so a slide's lines are no longer than its grid.
    boxes = whole.repartition(tasks, "slide_id", "x", "y").groupBy("slide_id", "x", "y").agg(*[F.sum(n).alias(n) for n in names])
    corners = boxes.select("slide_id", F.inline(F.array(
        corner("lo", "lo", 1), corner("lo", "hi", -1), corner("hi", "lo", -1), corner("hi", "hi", 1))))
    marks = corners.repartition(tasks, "slide_id", "line").groupBy("slide_id", "line", "at").agg(*[F.sum(n).alias(n) for n in names])

    def running(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Sums up to each mark, of which no two are at one place, and the stretch on which they hold."""
        w = W.partitionBy(*keys).orderBy(order)
        upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select(*keys, F.col(order).alias("lo"), (F.lead(order).over(w) - 1).alias("hi"), *[F.sum(n).over(upto).alias(n) for n in names])

    steps = running(marks, ["slide_id", "line"], "at").filter(((F.col("n") != 0) | (F.col("high") != 0) | (F.col("low") != 0)) & F.col("hi").isNotNull())
    wide = steps.select("slide_id", "line", F.explode(F.sequence("lo", "hi")).alias("cell_x"), *names)
    cells = running(wide.repartition(tasks, "slide_id", "cell_x"), ["slide_id", "cell_x"], "line").filter((F.col("n") > 0) & F.col("hi").isNotNull())
    mean = (F.col("high") + F.col("low") / float(1 << 40)) / float(1 << 30) / F.col("n")
    return cells.select("slide_id", "cell_x", F.explode(F.sequence("lo", "hi")).alias("cell_y"), mean.alias("mean"), "n")
