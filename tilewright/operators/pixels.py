"""Mask-level pixel tables ``slide_id, row, col, r, g, b``: contrast, colour masks and patch tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.functions import colour
from tilewright.operators import runs

KEYS = ["slide_id"]
CHANNELS = ("r", "g", "b")


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def image_sizes(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        (F.max("col") + 1).cast("bigint").alias("width"), (F.max("row") + 1).cast("bigint").alias("height"))


def _mean_gray(rounded: bool) -> Column:
    mean = F.avg(colour.gray(*_rgb()))
    return F.floor(mean + 0.5 if rounded else mean).cast("bigint").alias("mean_gray")


def mean_gray(pixels: DataFrame, rounded: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Mean luma per image: rounded to the nearest integer, or truncated."""
    return pixels.groupBy(*keys).agg(_mean_gray(rounded))


def _blend(value: Column, mean: Column, factor: float, rounded: bool) -> Column:
    out = mean + (value - mean) * F.lit(float(factor))
    limited = F.least(F.greatest(out, F.lit(0.0)), F.lit(255.0))
    return (F.bround(limited, 0) if rounded else limited).cast("bigint")


def enhance_contrast(pixels: DataFrame, factor: float, weighted: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Blend every pixel away from the mean gray of its image.

    The default truncates after the blend and rounds the mean; ``weighted`` does the opposite.
    """
    joined = pixels.join(mean_gray(pixels, not weighted, keys), keys)
    mean = F.col("mean_gray")
    return joined.withColumns({c: _blend(F.col(c), mean, factor, weighted) for c in CHANNELS}).drop("mean_gray")


def inverted(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: F.lit(255) - F.col(c) for c in CHANNELS})


def eosin_mask(pixels: DataFrame, contrast: float = 1, keys: list[str] = KEYS) -> DataFrame:
    df = pixels if contrast == 1 else enhance_contrast(pixels, contrast, keys=keys)
    return df.withColumn("fg", colour.eosin_foreground(*_rgb()))


def gray_mask(pixels: DataFrame, contrast: float = 20, cut: int = 210, keys: list[str] = KEYS) -> DataFrame:
    """Foreground is what stays at or below ``cut`` after the contrast step."""
    joined = pixels.join(mean_gray(pixels, True, keys), keys)
    shown = _blend(colour.gray(*_rgb()), F.col("mean_gray"), contrast, False)
    return joined.withColumn("fg", shown <= cut).drop("mean_gray")


def _coverage() -> Column:
    return F.bround(F.count_if(F.col("fg")) / F.count(F.lit(1)) * 100, 0).alias("coverage")


def coverage(masked: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Foreground share in whole percent."""
    return masked.groupBy(*keys).agg(_coverage())


def tissue_mask(
    pixels: DataFrame, contrast: float = 1, low: float = 5, high: float = 90, based_on: str = "hed", keys: list[str] = KEYS
) -> DataFrame:
    """Eosin mask; images whose coverage is below ``low`` or above ``high`` use the gray mask."""
    if based_on == "gray":
        return gray_mask(pixels, keys=keys)
    if based_on != "hed":
        raise NotImplementedError("tissue detection is based on 'hed' or 'gray'")
    eosin = eosin_mask(pixels, contrast, keys)
    if contrast == 1:  # the colours are as they were, so one pass gives share and mean
        facts = eosin.groupBy(*keys).agg(_coverage(), _mean_gray(True))
    else:
        facts = coverage(eosin, keys).join(mean_gray(pixels, True, keys), keys)
    gray = ((F.col("coverage") < low) | (F.col("coverage") > high)).alias("__gray")
    luma = colour.gray(*_rgb())
    joined = pixels.join(facts.select(*keys, gray, "mean_gray"), keys)
    by_gray = _blend(luma, F.col("mean_gray"), 20, False) <= 210
    if contrast != 1:
        seen = {c: _blend(F.col(c), F.col("mean_gray"), contrast, False) for c in CHANNELS}
        by_eosin = colour.eosin_foreground(*seen.values())
    else:
        by_eosin = colour.eosin_foreground(*_rgb())
    return joined.withColumn("fg", F.when(F.col("__gray"), by_gray).otherwise(by_eosin)).drop("__gray", "mean_gray")


def _with_hsv_bytes(pixels: DataFrame) -> DataFrame:
    """Computed once per pixel as columns, since every pen range looks at all three."""
    h, s, v = colour.hsv_bytes(*_rgb())
    return pixels.withColumns({"__h": h, "__s": s, "__v": v})


def _pen(name: str) -> Column:
    return colour.in_pen_range(F.col("__h"), F.col("__s"), F.col("__v"), name)


def pen_flags(pixels: DataFrame, colours: tuple[str, ...] = ("black", "blue", "green", "red")) -> DataFrame:
    return _with_hsv_bytes(pixels).withColumns({f"pen_{c}": _pen(c) for c in colours}).drop("__h", "__s", "__v")


def pen_marker_runs(
    pixels: DataFrame, sizes: DataFrame, colours: tuple[str, ...] = ("black", "blue", "green", "red"),
    grow: int = 0, keys: list[str] = KEYS,
) -> DataFrame:
    """Pen marks as runs: black and red are opened first; ``grow`` widens all by a square."""
    hits = F.inline(F.array(*[F.struct(F.lit(c).alias("pen"), _pen(c).alias("hit")) for c in colours]))
    marked = _with_hsv_bytes(pixels).select(*keys, "row", "col", hits).filter("hit")
    inner = [*keys, "pen"]
    lines = runs.from_pixels(marked, inner)
    rough = F.col("pen").isin("black", "red")
    images = sizes.withColumn("pen", F.explode(F.array(*[F.lit(c) for c in colours])))
    clean = runs.opened(lines, images, runs.ELLIPSE_5, inner, only=rough)
    # The growth of a union is the union of what its parts grow to.
    return runs.dilate(clean, sizes, runs.square(grow), keys) if grow else runs.merge(clean, keys)


def combine(tissue: DataFrame, markers: DataFrame, sizes: DataFrame, invert: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Tissue runs without marker runs, or everything else when inverted."""
    outside = runs.union(runs.complement(tissue, sizes, keys), markers, keys)
    return outside if invert else runs.complement(outside, sizes, keys)


Threshold = float | str | Callable[[DataFrame, str], DataFrame]


def _split_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides of every cut of a histogram with at most 256 values per image.

    ``n, s, q`` of each side: pixels, sum of values, sum of squared counts; ``next`` is the value
    after the cut. The last value is no cut and has an empty upper side.
    """
    w = W.partitionBy(*keys).orderBy("v")
    below = w.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    parts = {"n": F.col("n"), "s": F.col("v") * F.col("n"), "q": (F.col("n") * F.col("n")).cast("double")}
    sides = {}
    for name, value in parts.items():
        sides[f"low_{name}"] = F.sum(value).over(below)
        sides[f"high_{name}"] = F.sum(value).over(whole) - F.sum(value).over(below)
    return counts.select(*keys, "v", "width", F.lead("v").over(w).alias("next"), *[c.alias(k) for k, c in sides.items()])


def _first_best(table: DataFrame, score: Column, keys: list[str]) -> DataFrame:
    """The smallest value with the largest score; an image with one value keeps that value."""
    scored = table.withColumn("__score", F.round(score, 6))
    best = scored.groupBy(*keys).agg(F.max(F.when(
        F.col("__score").isNotNull(), F.struct("__score", (-F.col("v")).alias("neg")))).alias("m"), F.min("v").alias("only"))
    return best.select(*keys, F.coalesce(-F.col("m.neg"), F.col("only")).alias("threshold"))


WHOLE_NUMBERS = {"r", "g", "b", "R", "G", "B", "L"}


def histogram(pixels: DataFrame, channel: str, keys: list[str] = KEYS, bins: int = 256) -> DataFrame:
    """``keys, v, n, width``: one row per byte value, or per centre of equal bins for other channels."""
    if channel in WHOLE_NUMBERS:
        counted = pixels.groupBy(*keys, F.col(channel).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn("width", F.lit(1.0))
    span = pixels.groupBy(*keys).agg(F.min(channel).alias("__lo"), F.max(channel).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.coalesce(F.least(F.floor(F.try_divide(F.col(channel) - F.col("__lo"), width)), F.lit(bins - 1)), F.lit(0))
    centre = F.col("__lo") + (index + 0.5) * width
    return pixels.join(span, keys).groupBy(*keys, centre.alias("v"), width.alias("width")).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(pixels: DataFrame, channel: str, keys: list[str] = KEYS) -> DataFrame:
    """The first histogram value with the largest between-class variance."""
    table = _split_table(histogram(pixels, channel, keys), keys)
    gap = F.col("low_s") / F.col("low_n") - F.try_divide(F.col("high_s"), F.col("high_n").cast("double"))
    return _first_best(table, F.col("low_n") * F.col("high_n") * gap * gap, keys)


def yen_threshold(pixels: DataFrame, channel: str, keys: list[str] = KEYS) -> DataFrame:
    """The first histogram value with the largest entropic correlation of both sides."""
    table = _split_table(histogram(pixels, channel, keys), keys)
    total = (F.col("low_n") + F.col("high_n")).cast("double")
    share = F.col("low_n") / total
    odds = F.try_divide(F.pow(share * (1 - share), F.lit(2.0)), F.col("low_q") / total / total * (F.col("high_q") / total / total))
    return _first_best(table, F.when(F.col("high_n") > 0, F.log(odds)), keys)


def isodata_threshold(pixels: DataFrame, channel: str, keys: list[str] = KEYS) -> DataFrame:
    """The first histogram value that lies within one bin below the middle of both side means."""
    table = _split_table(histogram(pixels, channel, keys), keys)
    middle = (F.col("low_s") / F.col("low_n") + F.try_divide(F.col("high_s"), F.col("high_n").cast("double"))) / 2
    hops = F.floor((middle - F.col("v")) / F.col("width"))
    fits = (middle >= F.col("v")) & (hops < F.round((F.col("next") - F.col("v")) / F.col("width"), 0))
    found = F.min(F.when(fits, F.col("v") + hops * F.col("width")))
    return table.groupBy(*keys).agg(F.coalesce(found, F.min("v")).alias("threshold"))


def mean_threshold(pixels: DataFrame, channel: str, keys: list[str] = KEYS) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(channel).alias("threshold"))


NAMED = {"otsu": otsu_threshold, "mean": mean_threshold, "yen": yen_threshold, "isodata": isodata_threshold}


def channel_mask(
    pixels: DataFrame, thresholds: dict[str, Threshold], invert: bool = False, enhance: bool = False, keys: list[str] = KEYS
) -> DataFrame:
    """Foreground by channel cut-offs: any of R, G, B at or below; any of H, S, V above; any of
    H, E, D present (spelled ``HED_H``, ``HED_E``, ``HED_D``); L at or below. Colour spaces are
    and-ed. A cut-off is a number, a named rule or a callable ``(pixels, channel) -> keys, threshold``.
    """
    known = {"R", "G", "B", "H", "S", "V", "L", "HED_H", "HED_E", "HED_D"}
    wanted = {k.upper(): v for k, v in thresholds.items() if v is not None}
    if not wanted or not set(wanted) <= known:
        raise ValueError(f"give a threshold for at least one of {sorted(known)}")
    df = inverted(pixels) if invert else pixels
    if enhance:
        df = enhance_contrast(df, 2, weighted=True, keys=keys)
    hue, sat, val = colour.hsv(*_rgb())
    df = df.withColumns({
        "R": F.col("r"), "G": F.col("g"), "B": F.col("b"), "H": hue, "S": sat, "V": val, "L": colour.gray(*_rgb()),
        **{f"HED_{n}": colour.stain(*_rgb(), i) for i, n in enumerate("HED")},
    })
    source = df
    cuts: dict[str, Column] = {}
    for channel, rule in wanted.items():
        if channel.startswith("HED_"):
            continue
        if isinstance(rule, (int, float)):
            cuts[channel] = F.lit(float(rule))
            continue
        if isinstance(rule, str) and rule.lower() not in NAMED:
            raise ValueError(f"named rules are {sorted(NAMED)}; pass a callable for another")
        fn = NAMED[rule.lower()] if isinstance(rule, str) else rule
        found = fn(source, channel).withColumnRenamed("threshold", f"__t_{channel}")
        df = df.join(found, keys)
        cuts[channel] = F.col(f"__t_{channel}")

    def any_of(names: list[str], test: Callable[[str], Column]) -> Column | None:
        hits = [test(n) for n in names if n in wanted]
        out = None
        for h in hits:
            out = h if out is None else out | h
        return out

    spaces = [
        any_of(["R", "G", "B"], lambda c: F.col(c) <= cuts[c]),
        any_of(["H", "S", "V"], lambda c: F.col(c) > cuts[c]),
        any_of(["HED_H", "HED_E", "HED_D"], lambda c: F.col(c) != 0),
        any_of(["L"], lambda c: F.col(c) <= cuts[c]),
    ]
    mask = F.lit(True)
    for s in spaces:
        if s is not None:
            mask = mask & s
    return df.withColumn("fg", mask).select(*pixels.columns, "fg")


def patch_tests(
    pixels: DataFrame, tile: list[str], white_saturation: float = 15, black_mean: float = 50,
    black_level: int = 20, black_share: float = 0.05, white_level: int = 220, white_share: float = 0.2,
) -> DataFrame:
    """Four flags per tile: mean saturation low, all channel means low, enough dark, enough bright pixels."""
    r, g, b = _rgb()
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(F.round((top - low) * 255.0 / top, 0))
    stats = pixels.groupBy(*tile).agg(
        F.avg(saturation).alias("s"), F.greatest(F.avg("r"), F.avg("g"), F.avg("b")).alias("m"),
        F.count_if(top < black_level).alias("dark"), F.count_if(low > white_level).alias("bright"),
        F.count(F.lit(1)).alias("n"))
    return stats.select(
        *tile, (F.col("s") < white_saturation).alias("is_white"), (F.col("m") < black_mean).alias("is_black"),
        (F.col("dark") > F.col("n") * black_share).alias("is_black_s"),
        (F.col("bright") > F.col("n") * white_share).alias("is_white_s"))


def foreground(masked: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return masked.filter(F.col("fg")).select(*keys, "row", "col")
