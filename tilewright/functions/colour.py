"""Pixel colour arithmetic on red, green and blue byte columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Second column of the inverse stain matrix, and the strongest response of the
# first stain, as published for the haematoxylin, eosin and DAB separation.
EOSIN_WEIGHTS = (-1.00767869, 1.13473037, -0.48041419)
FIRST_STAIN_PEAK = 0.70
# The inverse of the same matrix, row by row.
STAIN_MATRIX = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
FLOOR = 1e-6


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma in 16-bit fixed point, rounded."""
    return F.shiftright((r * 19595 + g * 38470 + b * 7471 + 32768).cast("bigint"), 16)


def optical(value: Column) -> Column:
    return F.log(F.greatest(value / 255.0, F.lit(FLOOR))) / math.log(FLOOR)


def _inverse(m: tuple) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]


def stain(r: Column, g: Column, b: Column, index: int) -> Column:
    """Concentration of stain 0 (haematoxylin), 1 (eosin) or 2 (DAB), never negative."""
    w = EOSIN_WEIGHTS if index == 1 else tuple(row[index] for row in _inverse(STAIN_MATRIX))
    total = optical(r) * w[0] + optical(g) * w[1] + optical(b) * w[2]
    return F.greatest(total, F.lit(0.0))


def eosin_foreground(r: Column, g: Column, b: Column, white: float = 0.95) -> Column:
    """Eosin shown through the first stain leaves a channel below ``white``: one comparison."""
    cut = -math.log(white) / (6 * math.log(10) * FIRST_STAIN_PEAK)
    return stain(r, g, b, 1) > cut


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in [0, 1]; between equal maxima the later channel decides the hue."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = (top - low).cast("double")
    sector = (
        F.when(delta == 0, F.lit(0.0))
        .when(b == top, (r - g) / delta + 4.0)
        .when(g == top, (b - r) / delta + 2.0)
        .otherwise((g - b) / delta)
    )
    hue = F.pmod(sector / 6.0, F.lit(1.0))
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(delta / top)
    return hue, saturation, top / 255.0


def hsv_bytes(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    h, s, v = hsv(r, g, b)
    return tuple((c * 255).cast("int") for c in (h, s, v))  # type: ignore[return-value]


# Lower and upper (hue, saturation, value) bytes of each pen colour.
PEN_RANGES = {
    "black": [((0, 0, 0), (255, 255, 165))],
    "blue": [((130, 50, 30), (180, 255, 255))],
    "green": [((30, 30, 50), (130, 255, 255))],
    "red": [((0, 30, 30), (30, 255, 255)), ((200, 100, 100), (255, 255, 255))],
}


def in_pen_range(h: Column, s: Column, v: Column, colour: str) -> Column:
    """Does a (hue, saturation, value) byte triple lie in a range of this pen colour."""
    hit = F.lit(False)
    for low, high in PEN_RANGES[colour]:
        inside = F.lit(True)
        for c, lo, hi in zip((h, s, v), low, high):
            if lo > 0:
                inside = inside & (c >= lo)
            if hi < 255:
                inside = inside & (c <= hi)
        hit = hit | inside
    return hit
