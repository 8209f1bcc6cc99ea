"""Polygons cut by scan lines: which parts of a row lie inside, as runs.

An edge meets a row in one place, so a polygon is an edge table, a row sees only the edges that span it,
and one sort of their crossings gives the runs of the row: between an odd and an even crossing a point is
inside, on an edge it is covered. Rows and columns are whole numbers and all arithmetic is exact; where
half pixels matter, callers double everything. No ring is carried by a row or a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.functions import geometry as geo

#: Height in pixels of the bands in which edges meet rows that follow no lattice.
BAND = 64


def floor_div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, rounded down; ``b`` is positive."""
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def edge_table(polygons: DataFrame, keep: list[str]) -> DataFrame:
    """One row per edge, ``keep, x1, y1, x2, y2`` as whole numbers."""
    at = polygons.select(*keep, F.inline(geo.edges(F.col("points"))))
    return at.select(*keep, *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


def on_lattice(edges: DataFrame, first: Column, step: Column, count: Column, name: str = "line") -> DataFrame:
    """Every edge with each row ``first + line * step``, ``0 <= line < count``, that it spans or touches.

    An edge makes as many rows as it spans, so the work is that of drawing the outline once.
    """
    low = F.greatest(F.lit(0), ceil_div(F.least("y1", "y2") - first, step))
    high = F.least(count - 1, floor_div(F.greatest("y1", "y2") - first, step))
    lines = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return edges.withColumn(name, F.explode(lines)).withColumn("row", first + F.col(name) * step)


def at_rows(edges: DataFrame, rows: DataFrame, keys: list[str], height: int = BAND) -> DataFrame:
    """Edges joined with the rows (``keys, row``, each once) that they span or touch.

    Both are cut into bands of ``height``, so an edge meets the rows of its bands only. Bands and rows grow with
    the polygons, but are planned as small as the table they come from; the hint keeps them off the driver.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    band = lambda y: floor_div(y, F.lit(height))
    spread = edges.withColumn("__band", F.explode(F.sequence(band(low), band(high))))
    lines = rows.select(*keys, "row", band(F.col("row")).alias("__band"))
    return spread.hint("merge").join(lines, [*keys, "__band"]).filter(F.col("row").between(low, high)).drop("__band")


def _crossings(crossed: DataFrame, keep: list[str]) -> DataFrame:
    """What an edge does in a row as marks ``keep, at, turn, touch``.

    A crossing turns inside and outside; a point is left of it if it is strictly left of the edge, and an
    edge counts for rows from its lower end up to, without, its upper end. Contact covers a stretch.
    """
    row, x1, y1, x2, y2 = (F.col(c) for c in ("row", "x1", "y1", "x2", "y2"))
    flat = y1 == y2
    height = F.when(flat, F.lit(1).cast("bigint")).otherwise(F.abs(y2 - y1))
    run = (row - y1) * (x2 - x1)
    run = F.when(y2 < y1, -run).otherwise(run)
    rest = F.pmod(run, height)
    at = x1 + F.call_function("div", run - rest, height)
    # Plain columns first: a generator would compute what it repeats anew each time.
    met = crossed.select(
        *keep, flat.alias("__flat"), (rest == 0).alias("__whole"), ((y1 > row) != (y2 > row)).alias("__crosses"), at.alias("__at"),
        F.least(x1, x2).alias("__left"), F.greatest(x1, x2).alias("__right"))
    touches = F.col("__flat") | F.col("__whole")
    ends = met.select(
        *keep, F.when(F.col("__crosses"), F.col("__at") + F.when(F.col("__whole"), 0).otherwise(1)).alias("__turn"),
        F.when(touches, F.when(F.col("__flat"), F.col("__left")).otherwise(F.col("__at"))).alias("__from"),
        F.when(touches, F.when(F.col("__flat"), F.col("__right")).otherwise(F.col("__at")) + 1).alias("__to"))

    def mark(place: str, turn: int, touch: int) -> Column:
        return F.struct(F.col(place).alias("at"), F.lit(turn).alias("turn"), F.lit(touch).alias("touch"))

    marks = ends.select(*keep, F.inline(F.array(mark("__turn", 1, 0), mark("__from", 0, 1), mark("__to", 0, -1))))
    return marks.filter(F.col("at").isNotNull())


def stretches(marks: DataFrame, keys: list[str], sums: list[str], holds: Column, carry: list[str] | None = None) -> DataFrame:
    """``keys, carry, start, stop``: the longest stretches on which ``holds`` is true of the running ``sums``.

    ``marks`` holds ``keys, at`` and what each mark adds to the sums from there on; ``carry`` are columns that are
    constant within ``keys``. Marks at one place count together. A window holds the marks of one row.
    """
    w = W.partitionBy(*keys).orderBy("at")
    carry = carry or []
    # Marks at one place share their sums, so all but the first of them see no change.
    ran = marks.select(*keys, *carry, "at", *[F.sum(s).over(w).alias(s) for s in sums]).withColumn("__on", holds)
    turns = ran.withColumn("__was", F.coalesce(F.lag("__on").over(w), F.lit(False))).filter(F.col("__on") != F.col("__was"))
    runs = turns.select(*keys, *carry, F.col("at").alias("start"), (F.lead("at").over(w) - 1).alias("stop"), "__on")
    return runs.filter("__on").drop("__on")


def covered(crossed: DataFrame, keys: list[str], carry: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Runs ``keys, carry, start, stop`` of each row's part inside a polygon or, unless ``strict``, on its edge.

    ``crossed`` holds edges with their ``row``; ``keys`` name one row of one polygon.
    """
    marks = _crossings(crossed, [*keys, *(carry or [])])
    odd, contact = F.col("turn") % 2 == 1, F.col("touch") > 0
    return stretches(marks, keys, ["turn", "touch"], odd & ~contact if strict else odd | contact, carry)


def ends(start: Column, stop: Column) -> Column:
    """A run as two marks of ``open``."""
    def mark(at: Column, n: int) -> Column:
        return F.struct(at.cast("bigint").alias("at"), F.lit(n).alias("open"))

    return F.inline(F.array(mark(start, 1), mark(stop + 1, -1)))


def joined(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The union of runs that may overlap or touch, as the longest runs ``keys, start, stop``."""
    marks = runs.select(*keys, ends(F.col("start"), F.col("stop")))
    return stretches(marks, keys, ["open"], F.col("open") > 0)


def fill(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Runs ``keys, row, start, stop`` of the pixels that each polygon covers, its edge included."""
    edges = edge_table(polygons, keys)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossed = edges.withColumn("row", F.explode(F.sequence(low, high)))
    return covered(crossed, [*keys, "row"])


def topmost(runs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Disjoint pieces of overlapping runs with the largest ``name`` among those that cover a piece."""
    ends = runs.select(*keys, F.explode(F.array("start", F.col("stop") + 1)).alias("at")).distinct()
    pieces = ends.select(*keys, "at", F.lead("at").over(W.partitionBy(*keys).orderBy("at")).alias("next")).filter("next is not null")
    met = pieces.join(runs, keys).filter((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("stop")))
    return met.groupBy(*keys, "at", "next").agg(F.max(name).alias(name)).select(
        *keys, F.col("at").alias("start"), (F.col("next") - 1).alias("stop"), name)
