"""Pyramid levels and the parameters derived from them. ``levels`` is an array of (w, h, downsample)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIZE_CAP = 100_000_000


def level_downsamples(levels: Column) -> Column:
    """(w0 / w, h0 / h) per level."""
    base = F.get(levels, F.lit(0))
    return F.transform(levels, lambda l: F.struct((base["w"] / l["w"]).alias("dx"), (base["h"] / l["h"]).alias("dy")))


def best_level(levels: Column, target: float) -> Column:
    """The coarsest level with a downsample of at most ``target``; level 0 if there is none."""
    fitting = F.transform(levels, lambda l, i: F.when(l["downsample"] <= target, i).otherwise(0))
    return F.when(F.size(levels) <= 1, 0).otherwise(F.array_max(fitting))


def chosen_level(requested: Column, levels: Column, target: float = 64) -> Column:
    return F.when(requested < 0, best_level(levels, target)).otherwise(requested)


def best_mask_level(levels: Column, min_width: int = 1200) -> Column:
    """The coarsest level at least ``min_width`` wide; level 0 if there is none."""
    fitting = F.transform(levels, lambda l, i: F.when(l["w"] >= min_width, i).otherwise(0))
    return F.coalesce(F.array_max(fitting), F.lit(0))


def oversize(levels: Column, level: Column, cap: int = SIZE_CAP) -> Column:
    size = F.get(levels, level)
    return size["w"] * size["h"] > cap


def legacy_area(area: Column, sx: Column, sy: Column) -> Column:
    """Old pixel area as a multiple of the 512 x 512 reference patch, truncated."""
    return (area * (sx * sy) / F.lit(512.0 * 512.0)).cast("int")


def reference_area(sx: Column, sy: Column, ref: int = 512) -> Column:
    return (F.lit(float(ref * ref)) / (sx * sy)).cast("int")
