"""Threshold sweeps against slide labels.

One scan buckets every score on the grid; the counts per threshold follow from at most
``len(grid) + 1`` rows per slide, so a slide's tiles never gather in one task.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def slide_grid() -> list[float]:
    """109 cut-offs: steps of 0.01 up to 0.98, then steps of 0.001 from 0.99."""
    return [0.01 * i for i in range(99)] + [0.99 + 0.001 * i for i in range(10)]


def band_grid(lower: list[float], upper: list[float], step: list[float]) -> list[float]:
    """Half-open bands joined in order; the first and last values are forced to the outer ends."""
    if not len(lower) == len(upper) == len(step):
        raise ValueError("lower, upper and step need the same length")
    out: list[float] = []
    for lo, hi, st in zip(lower, upper, step):
        count = max(0, -int(-(hi - lo) / st // 1))
        out += [lo + st * i for i in range(count)]
    if out:
        out[0], out[-1] = min(lower), max(upper)
    return out


def grid_bucket(score: Column, grid: list[float], max_cells: int = 4096) -> Column:
    """How many grid values are at or below ``score``.

    The range is cut into equal cells. The cell of a score is monotone in the score, so every grid
    value of an earlier cell is below it and every value of a later cell above it; only the few
    values of its own cell are compared.
    """
    if any(a >= b for a, b in zip(grid, grid[1:])):
        raise ValueError("the grid must increase")
    low, span = grid[0], grid[-1] - grid[0]
    gap = min((b - a for a, b in zip(grid, grid[1:])), default=1.0)
    cells = max(1, min(max_cells, math.ceil(span / gap)))
    factor = cells / span if span else 1.0
    own = [math.floor((t - low) * factor) for t in grid]
    last = own[-1]
    before = [bisect.bisect_left(own, c) for c in range(last + 1)]
    most = max(bisect.bisect_right(own, c) - bisect.bisect_left(own, c) for c in range(last + 1))
    starts = F.expr("array(" + ",".join(map(str, before)) + ")")
    values = F.expr("array(" + ",".join(f"{t!r}D" for t in grid) + ")")
    cell = F.floor((score - F.lit(low)) * F.lit(factor))
    start = F.get(starts, F.least(F.greatest(cell, F.lit(0)), F.lit(last)).cast("int"))
    found = start
    for i in range(most):
        found = found + F.when(score >= F.get(values, start + i), 1).otherwise(0)
    return F.when(score < low, 0).when(score >= grid[-1], len(grid)).otherwise(found)


def sweep(tiles: DataFrame, score: str, grid: list[float] | None = None, slide: str = "slide_id") -> DataFrame:
    """``slide, t_idx, threshold, positive_tiles``: tiles at or above each cut-off."""
    grid = grid or slide_grid()
    n = len(grid)
    counts = (
        tiles.filter(F.col(score).isNotNull())
        .groupBy(slide, grid_bucket(F.col(score), grid).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("tiles"))
    )
    w = W.partitionBy(slide).orderBy("bucket")
    from_here = W.partitionBy(slide).orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, 0)
    steps = counts.select(
        slide, "bucket",
        F.sum("tiles").over(from_here).alias("at_least"),
        F.coalesce(F.lag("bucket").over(w), F.lit(0)).alias("below"),
        F.lead("bucket").over(w).isNull().alias("last"),
    )

    def run(first: Column, stop: Column, value: Column) -> Column:
        """Thresholds ``first .. stop - 1`` all have the same count."""
        indexes = F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(indexes, lambda i: F.struct(i.alias("t_idx"), value.alias("positive_tiles")))

    held = run(F.col("below"), F.col("bucket"), F.col("at_least"))
    tail = F.when(F.col("last"), run(F.col("bucket"), F.lit(n), F.lit(0).cast("bigint"))).otherwise(
        run(F.lit(0), F.lit(0), F.lit(0).cast("bigint"))
    )
    long = steps.select(slide, F.inline(F.concat(held, tail)))
    values = F.array(*[F.lit(t) for t in grid])
    return long.select(slide, "t_idx", F.get(values, F.col("t_idx")).alias("threshold"), "positive_tiles")


def pivot_sweep(swept: DataFrame, grid: list[float], slide: str = "slide_id") -> DataFrame:
    """One ``Threshold_<t>`` column per cut-off."""
    indexes = list(range(len(grid)))
    wide = swept.groupBy(slide).pivot("t_idx", indexes).agg(F.first("positive_tiles"))
    return wide.select(slide, *[F.col(str(i)).alias(f"Threshold_{t}") for i, t in zip(indexes, grid)])


def confusion(swept: DataFrame, labels: DataFrame, slide: str = "slide_id", label: str = "label") -> DataFrame:
    """Confusion counts per cut-off; a slide is positive from one tile on. Unlabelled slides drop out."""
    hit = F.col("positive_tiles") >= 1
    truth = F.col(label) == 1
    joined = swept.join(labels.filter(F.col(label).isNotNull()), slide)
    return joined.groupBy("t_idx", "threshold").agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero on a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp)})


def best_at_sensitivity(rated: DataFrame, target: float = 0.7) -> DataFrame:
    """Highest specificity above zero among cut-offs reaching the target; the first wins."""
    return (
        rated.filter((F.col("sensitivity") >= target) & (F.col("specificity") > 0))
        .orderBy(F.col("specificity").desc(), "threshold").limit(1)
    )


def youden(rated: DataFrame) -> DataFrame:
    """The first cut-off with the largest J."""
    j = rated.withColumn("j", F.col("sensitivity") + F.col("specificity") - 1)
    return j.orderBy(F.col("j").desc(), "threshold").limit(1)


def sweep_roc(rated: DataFrame) -> DataFrame:
    """Points (fpr, tpr) in order, with the trapezoid each adds. At most one row per cut-off."""
    pts = rated.select("threshold", (1 - F.col("specificity")).alias("fpr"), F.col("sensitivity").alias("tpr"))
    w = W.orderBy("fpr", "tpr", "threshold")
    dx = F.col("fpr") - F.lag("fpr").over(w)
    mean = (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return pts.withColumn("area", F.coalesce(dx * mean, F.lit(0.0)))


def sweep_auroc(rated: DataFrame) -> DataFrame:
    return sweep_roc(rated).agg(F.sum("area").alias("auroc"))


def best_value(scored: DataFrame, value: str, threshold: str = "threshold", digits: int = 6) -> DataFrame:
    """The first cut-off with the largest value, and the cut-off rounded to ``digits``.

    Values that agree in twelve places are equal, so the order of a sum does not choose the cut-off.
    """
    ordered = scored.filter(F.col(value).isNotNull()).orderBy(F.round(value, 12).desc(), threshold)
    return ordered.limit(1).withColumn("cutoff", F.round(threshold, digits))


def f1_table(scored: DataFrame, keys: list[str], label: str = "label", count: str = "positive_tiles") -> DataFrame:
    """Precision, recall and F1 of "more than zero tiles" per key."""
    hit = F.col(count) > 0
    truth = F.col(label) == 1
    agg = [
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
    ]
    counts = scored.groupBy(*keys).agg(*agg)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def melt_rates(table: DataFrame, ids: list[str]) -> DataFrame:
    return table.unpivot(ids, ["precision", "recall"], "variable", "value")
