"""Binary masks as row runs: ``keys, row, start, stop`` with inclusive ends.

Morphology, complements and components work on runs, which are far fewer than pixels. All windows
are over one image row, so they hold at most as many rows as the image is wide. A dilation is the union of
shifted and widened runs, an erosion the intersection of shifted and narrowed ones: one sort of run ends
per image row either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.operators import scanline
from tilewright.operators.components import blocked_components

KEYS = ["slide_id"]
# Half width of a kernel at each row offset.
ELLIPSE_5 = {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
DISC_3 = {-3: 0, -2: 2, -1: 2, 0: 3, 1: 2, 2: 2, 3: 0}
# Wider than any image, and rows times this stay within 63 bits.
_ROW_BITS = 31
# Image rows that are labelled together before anything is linked across.
BAND_ROWS = 128


def square(size: int) -> dict[int, int]:
    """A square kernel of odd size."""
    half = size // 2
    return {d: half for d in range(-half, half + 1)}


def from_pixels(mask: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    w = W.partitionBy(*keys, "row").orderBy("col")
    return mask.select(*keys, "row", "col", (F.col("col") - F.row_number().over(w)).alias("__g")).groupBy(
        *keys, "row", "__g"
    ).agg(F.min("col").alias("start"), F.max("col").alias("stop")).drop("__g")


def to_pixels(runs: DataFrame, keep: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    return runs.select(*keys, "row", F.explode(F.sequence("start", "stop")).alias("col"), *(keep or []))


def merge(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Join overlapping and adjacent runs of a row."""
    w = W.partitionBy(*keys, "row").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = runs.select(*keys, "row", "start", "stop", (before.isNull() | (F.col("start") > before + 1)).cast("int").alias("__new"))
    return opened.withColumn("__g", F.sum("__new").over(w)).groupBy(*keys, "row", "__g").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__g")


def union(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    cols = [*keys, "row", "start", "stop"]
    return merge(a.select(*cols).unionByName(b.select(*cols)), keys)


def complement(runs: DataFrame, sizes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Background runs of images given as ``keys, width, height``; runs must be merged."""
    zero = F.lit(0).cast("bigint")
    walls = sizes.select(*keys, "width", F.explode(F.sequence(zero, F.col("height") - 1)).alias("row"))
    ends = walls.select(
        *keys, "row",
        F.inline(F.array(
            F.struct((zero - 1).alias("start"), (zero - 1).alias("stop")),
            F.struct(F.col("width").cast("bigint").alias("start"), F.col("width").cast("bigint").alias("stop")),
        )),
    )
    w = W.partitionBy(*keys, "row").orderBy("start")
    gaps = runs.select(*keys, "row", "start", "stop").unionByName(ends).select(
        *keys, "row", (F.col("stop") + 1).alias("start"), (F.lead("start").over(w) - 1).alias("stop"))
    return gaps.filter(F.col("start") <= F.col("stop"))


def _kernel(kernel: dict[int, int], only: Column | None) -> Column:
    """The kernel as structs of row offset and half width; one point where ``only`` does not hold."""
    def points(items: dict[int, int]) -> Column:
        return F.array(*[F.struct(F.lit(d).cast("bigint").alias("d"), F.lit(h).cast("bigint").alias("h")) for d, h in items.items()])

    return points(kernel) if only is None else F.when(only, points(kernel)).otherwise(points({0: 0}))


def dilate(runs: DataFrame, sizes: DataFrame, kernel: dict[int, int], keys: list[str] = KEYS, only: Column | None = None) -> DataFrame:
    """Grow by a kernel that is symmetric about its row axis; clipped to the image.

    ``only``, a condition on the keys, says which images grow; the others stay.
    """
    grown = runs.select(*keys, "row", "start", "stop", F.inline(_kernel(kernel, only))).join(sizes, keys)
    grown = grown.withColumn("row", F.col("row") + F.col("d")).filter((F.col("row") >= 0) & (F.col("row") < F.col("height")))
    low, high = F.greatest(F.col("start") - F.col("h"), F.lit(0)), F.least(F.col("stop") + F.col("h"), F.col("width") - 1)
    marks = grown.select(*keys, "row", scanline.ends(low, high))
    return scanline.stretches(marks, [*keys, "row"], ["open"], F.col("open") > 0)


def erode(runs: DataFrame, sizes: DataFrame, kernel: dict[int, int], keys: list[str] = KEYS, only: Column | None = None) -> DataFrame:
    """Shrink; pixels outside the image do not count against a pixel. The runs must be merged.

    A pixel stays if every row of the kernel that lies in the image has it inside a narrowed run.
    """
    moved = runs.select(*keys, "row", "start", "stop", F.inline(_kernel(kernel, only))).join(sizes, keys)
    moved = moved.withColumn("row", F.col("row") - F.col("d")).filter((F.col("row") >= 0) & (F.col("row") < F.col("height")))
    low = F.when(F.col("start") <= 0, F.lit(0)).otherwise(F.col("start") + F.col("h"))
    high = F.when(F.col("stop") >= F.col("width") - 1, F.col("width") - 1).otherwise(F.col("stop") - F.col("h"))
    inside = [((F.col("row") + d >= 0) & (F.col("row") + d < F.col("height"))).cast("int") for d in kernel]
    need = sum(inside[1:], inside[0])
    need = need if only is None else F.when(only, need).otherwise(1)
    narrowed = moved.select(*keys, "row", need.alias("need"), low.alias("low"), high.alias("high")).filter("low <= high")
    marks = narrowed.select(*keys, "row", "need", scanline.ends(F.col("low"), F.col("high")))
    return scanline.stretches(marks, [*keys, "row"], ["open"], F.col("open") == F.col("need"), ["need"]).drop("need")


def opened(
    runs: DataFrame, sizes: DataFrame, kernel: dict[int, int] = ELLIPSE_5, keys: list[str] = KEYS, only: Column | None = None
) -> DataFrame:
    return dilate(erode(runs, sizes, kernel, keys, only), sizes, kernel, keys, only)


def run_id() -> Column:
    """Raster-order id of a run; the smallest of a region names its first pixel."""
    return F.shiftleft(F.col("row"), _ROW_BITS) + F.col("start")


def label_runs(runs: DataFrame, keys: list[str] = KEYS, connectivity: int = 8, name: str = "region") -> DataFrame:
    """Runs with the id of their region; the runs must be merged.

    Links inside a band of image rows are contracted in one pass, so only links across bands go through
    rounds. Not lazy: see ``blocked_components``.
    """
    reach = 1 if connectivity == 8 else 0

    def band(ident: Column) -> Column:
        return F.floor(F.shiftright(ident, _ROW_BITS) / BAND_ROWS)

    def edges(nodes: DataFrame) -> DataFrame:
        """Links of neighbouring rows, one look back per run.

        Two rows are sorted together by start. Runs of a row do not touch, so of the other row
        only the last run before this one can reach it; later runs look back themselves.
        """
        here = F.struct("stop", "id")
        pair = nodes.select(
            *keys, "start", "stop", "id",
            F.inline(F.array(
                F.struct(F.col("row").alias("__pair"), F.lit(0).alias("__side")),
                F.struct((F.col("row") + 1).alias("__pair"), F.lit(1).alias("__side")))))
        w = W.partitionBy(*keys, "__pair").orderBy("start", "__side").rowsBetween(W.unboundedPreceding, -1)

        def last_of(side: int) -> Column:
            return F.last(F.when(F.col("__side") == side, here), ignorenulls=True).over(w)

        seen = pair.withColumns({"__zero": last_of(0), "__one": last_of(1)}).withColumn(
            "__other", F.when(F.col("__side") == 0, F.col("__one")).otherwise(F.col("__zero")))
        other = F.col("__other.id")
        return seen.filter(F.col("__other.stop") + reach >= F.col("start")).select(
            *keys, other.alias("src"), F.col("id").alias("dst"), F.when(band(other) == band(F.col("id")), band(other)).alias("block"))

    nodes = runs.select(*keys, "row", "start", "stop", run_id().alias("id"))
    return blocked_components(nodes, edges, keys, "id", name).drop("id")


def region_properties(labelled: DataFrame, keys: list[str] = KEYS, name: str = "region") -> DataFrame:
    """Area, centroid and half-open bounding box per region."""
    n = F.col("stop") - F.col("start") + 1
    area = F.sum(n)
    return labelled.groupBy(*keys, name).agg(
        area.alias("area"),
        (F.sum(F.col("row") * n) / area).alias("centroid_row"),
        (F.sum((F.col("start") + F.col("stop")) * n) / 2 / area).alias("centroid_col"),
        F.min("row").alias("min_row"), F.min("start").alias("min_col"),
        (F.max("row") + 1).alias("max_row"), (F.max("stop") + 1).alias("max_col"))


def fill_holes(runs: DataFrame, sizes: DataFrame, keys: list[str] = KEYS, connectivity: int = 4) -> DataFrame:
    """Background components that do not reach the image border become foreground."""
    background = label_runs(complement(runs, sizes, keys), keys, connectivity, "__bg")
    at_border = (
        (F.col("row") == 0) | (F.col("row") == F.col("height") - 1)
        | (F.col("start") == 0) | (F.col("stop") == F.col("width") - 1))
    open_air = background.join(sizes, keys).filter(at_border).select(*keys, "__bg").distinct()
    closed = background.join(open_air, [*keys, "__bg"], "left_anti")
    return union(runs, closed, keys)


def boundary_counts(labelled: DataFrame, keys: list[str] = KEYS, name: str = "region") -> DataFrame:
    """``keys, name, boundary``: pixels with a 4-neighbour outside their region; the image edge counts as outside.

    What is inside lies on three runs at once: a narrowed one of its row and those above and below.
    """
    inner = [*keys, name]

    def part(row: Column, start: Column, stop: Column) -> Column:
        return F.struct(row.alias("row"), start.alias("start"), stop.alias("stop"))

    row, start, stop = F.col("row"), F.col("start"), F.col("stop")
    parts = labelled.select(*inner, F.inline(F.array(part(row - 1, start, stop), part(row + 1, start, stop), part(row, start + 1, stop - 1))))
    marks = parts.filter("start <= stop").select(*inner, "row", scanline.ends(start, stop))
    deep = scanline.stretches(marks, [*inner, "row"], ["open"], F.col("open") == 3).select(*inner, (start - stop - 1).alias("n"))
    every = labelled.select(*inner, (stop - start + 1).alias("n"))
    return every.unionByName(deep).groupBy(*inner).agg(F.sum("n").alias("boundary"))


def drop_small(
    labelled: DataFrame, sizes: DataFrame, min_pixel_count: int, grow: dict[int, int] | None = None, keys: list[str] = KEYS,
) -> DataFrame:
    """Regions with a long enough boundary, grown and merged where they touch; runs, not yet labelled."""
    counts = boundary_counts(labelled, keys)
    kept = labelled.join(counts.filter(F.col("boundary") >= min_pixel_count), [*keys, "region"], "left_semi")
    plain = kept.select(*keys, "row", "start", "stop")
    return dilate(plain, sizes, grow if grow is not None else DISC_3, keys)
