"""Polygon arithmetic on ``array<struct<x, y>>`` columns. Integer input stays in exact integers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def edges(points: Column) -> Column:
    """Closed edge list: each point with its successor."""
    turned = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(points, turned, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(points: Column) -> Column:
    return _total(F.transform(edges(points), lambda e: _cross(e).cast("double"))) / 2


def contour_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def centroid(points: Column) -> tuple[Column, Column]:
    """Truncated moment centroid; the denominator carries a guard of 1e-9."""
    m00 = signed_area(points)
    sign = F.when(m00 < 0, -1.0).otherwise(1.0)

    def moment(a: str, b: str) -> Column:
        return _total(F.transform(edges(points), lambda e: ((e[a] + e[b]) * _cross(e)).cast("double"))) / 6

    def place(m: Column) -> Column:
        return F.when(m00 == 0, F.lit(0).cast("bigint")).otherwise((sign * m / (F.abs(m00) + 1e-9)).cast("bigint"))

    return place(moment("x1", "x2")), place(moment("y1", "y2"))


def bounding_rect(points: Column) -> Column:
    """``x, y, w, h`` with inclusive extents."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h"),
    )


def scale_points(points: Column, sx: Column, sy: Column, truncate: bool = True) -> Column:
    def value(v: Column) -> Column:
        return v.cast("bigint") if truncate else v

    return F.transform(points, lambda p: F.struct(value(p["x"] * sx).alias("x"), value(p["y"] * sy).alias("y")))


def _touches(e: Column, px: Column, py: Column, turn: Column) -> Column:
    return (
        (turn == 0)
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def position(ring: Column, px: Column, py: Column) -> Column:
    """2 on an edge, 1 inside, 0 outside; ``ring`` is the result of ``edges``.

    One pass over the edges: a hit on an edge sticks, otherwise every crossing of the ray to the
    right flips the state. Edges that do not span the row of the point are skipped at once.
    """

    def step(state: Column, e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])
        spans = (e["y1"] > py) != (e["y2"] > py)
        crosses = spans & F.when(e["y2"] > e["y1"], turn > 0).otherwise(turn < 0)
        near = (F.least(e["y1"], e["y2"]) <= py) & (py <= F.greatest(e["y1"], e["y2"]))
        return (
            F.when((state == 2) | ~near, state)
            .when(_touches(e, px, py, turn), 2)
            .when(crosses, 1 - state)
            .otherwise(state)
        )

    return F.aggregate(ring, F.lit(0), step)


def inside_or_edge(ring: Column, px: Column, py: Column) -> Column:
    return position(ring, px, py) >= 1


def strictly_inside(ring: Column, px: Column, py: Column) -> Column:
    return position(ring, px, py) == 1


# A contour predicate takes (ring, x, y, patch) columns, the ring being the edge list of the
# contour, and returns a boolean column.
Predicate = Callable[[Column, Column, Column, Column], Column]


def _half(patch: Column) -> Column:
    return F.floor(patch / 2).cast("bigint")


def _four(x: Column, y: Column, patch: Column) -> Column:
    """Four points around the centre; the centre alone when the shift is zero."""
    cx, cy = x + _half(patch), y + _half(patch)
    s = F.floor(_half(patch) * 0.5).cast("bigint")

    def at(a: Column, b: Column) -> Column:
        return F.struct(a.alias("x"), b.alias("y"))

    return F.when(
        s > 0, F.array(at(cx - s, cy - s), at(cx + s, cy + s), at(cx + s, cy - s), at(cx - s, cy + s))
    ).otherwise(F.array(at(cx, cy)))


def in_corner(ring: Column, x: Column, y: Column, patch: Column) -> Column:
    return inside_or_edge(ring, x, y)


def in_center(ring: Column, x: Column, y: Column, patch: Column) -> Column:
    return inside_or_edge(ring, x + _half(patch), y + _half(patch))


def in_four_any(ring: Column, x: Column, y: Column, patch: Column) -> Column:
    return F.exists(_four(x, y, patch), lambda p: inside_or_edge(ring, p["x"], p["y"]))


def in_four_all(ring: Column, x: Column, y: Column, patch: Column) -> Column:
    return F.forall(_four(x, y, patch), lambda p: inside_or_edge(ring, p["x"], p["y"]))


PREDICATES: dict[str, Predicate] = {
    "basic": in_corner,
    "center": in_center,
    "four_pt": in_four_any,
    "four_pt_hard": in_four_all,
}


def probe_offsets(test: str, patch: Column) -> tuple[Column, bool]:
    """Where a named test looks: offsets from the tile's corner, alike on both axes, and whether all must hit."""
    if test not in PREDICATES:
        raise NotImplementedError(f"contour test {test!r}; use one of {sorted(PREDICATES)} or a callable")
    half = _half(patch)
    shift = F.floor(half * 0.5).cast("bigint")
    if test == "basic":
        return F.array(F.lit(0).cast("bigint")), False
    if test == "center":
        return F.array(half), False
    return F.when(shift > 0, F.array(half - shift, half + shift)).otherwise(F.array(half)), test == "four_pt_hard"


def predicate(test: str | Predicate) -> Predicate:
    """A built-in test by name, or a callable of the same shape."""
    if callable(test):
        return test
    if test not in PREDICATES:
        raise NotImplementedError(f"contour test {test!r}; use one of {sorted(PREDICATES)} or a callable")
    return PREDICATES[test]


def sort_by_area(contours: DataFrame, keys: list[str], name: str = "cont_rank") -> DataFrame:
    """Zero-based rank by area, largest first. A slide has few contours, so a plain window is enough."""
    w = W.partitionBy(*keys).orderBy(F.col("area").desc(), F.to_json(F.struct("points")))
    return contours.withColumn("area", contour_area(F.col("points"))).withColumn(
        name, F.row_number().over(w).cast("bigint") - 1)
