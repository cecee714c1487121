"""Colour arithmetic on integer channel columns (0..255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of r, g and b in luma and chroma, and the numbers of the contrast formula.
YUV_WEIGHTS = ((0.299, 0.587, 0.114), (-0.169, -0.331, 0.5), (0.5, -0.419, -0.081))
CONTRAST_TOP, CONTRAST_MOST, CONTRAST_STEP = 259.0, 255.0, 2.55


def contrast_factor(contrast: int) -> float:
    c = max(-100, min(100, contrast)) * CONTRAST_STEP
    return (CONTRAST_TOP * (c + CONTRAST_MOST)) / (CONTRAST_MOST * (CONTRAST_TOP - c))


def _div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; null for a zero divisor."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0)))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..359, saturation 0..255, value; the first of r, g, b that is largest decides the hue's sector."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    sector = (
        F.when(spread == 0, 0)
        .when(r == top, _div((g - b) * 60, spread))
        .when(g == top, _div((b - r) * 60, spread) + 120)
        .otherwise(_div((r - g) * 60, spread) + 240)
    )
    hue = F.when(sector < 0, sector + 360).otherwise(sector)
    return hue.cast("long"), F.coalesce(_div(spread * 255, top), F.lit(0)).cast("long"), top.cast("long")


def yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer luma and chroma: truncated, then held in 0..255."""
    held = lambda x: F.least(F.greatest(x.cast("long"), F.lit(0)), F.lit(255)).cast("long")
    return tuple(held(w[0] * r + w[1] * g + w[2] * b + m) for w, m in zip(YUV_WEIGHTS, (0.0, 128.0, 128.0), strict=True))


def squared_distance(rgb: tuple[Column, Column, Column], to: tuple) -> Column:
    parts = [(c - F.lit(t)) * (c - F.lit(t)) for c, t in zip(rgb, to, strict=True)]
    return parts[0] + parts[1] + parts[2]


def chebyshev(rgb: tuple[Column, Column, Column], to: tuple) -> Column:
    return F.greatest(*[F.abs(c - (t if isinstance(t, Column) else F.lit(t))) for c, t in zip(rgb, to, strict=True)])


def hue_distance(hue: Column, reference: int) -> Column:
    """Distance on the half-scale circle of 180 steps."""
    d = F.abs(_div(hue, F.lit(2)) - F.lit(reference % 180))
    return F.least(d, 180 - d)


def palette_class(rgb: tuple, main: tuple, outline: tuple) -> Column:
    """2 where the outline colour is strictly nearer than the main one, else 1."""
    return F.when(chebyshev(rgb, outline) < chebyshev(rgb, main), 2).otherwise(1)


def overlay(hit: Column, rgb: tuple) -> tuple[Column, Column, Column]:
    """Hits keep their colour; the rest is tinted green."""
    dim = lambda c: F.floor(F.least(c * 2, F.lit(255)) / 2).cast("long")
    r, g, b = rgb
    return (
        F.when(hit, r).otherwise(dim(r) + 30).cast("long"),
        F.when(hit, g).otherwise(F.least(g + 90, F.lit(255))).cast("long"),
        F.when(hit, b).otherwise(dim(b)).cast("long"),
    )


def tone(rgb: tuple[Column, Column, Column], brightness: int, contrast: int, grey: bool = False) -> tuple[Column, Column, Column]:
    """Contrast (-100..100) around mid grey, brightness (-100..100) added, held in 0..255, rounded half away from zero."""
    bright, factor = float(max(-100, min(100, brightness))), contrast_factor(contrast)
    held = [F.least(F.greatest(F.lit(factor) * (x - 128.0) + 128.0 + F.lit(bright), F.lit(0.0)), F.lit(255.0)) for x in rgb]
    if grey:
        held = [sum((w * c for w, c in zip(YUV_WEIGHTS[0][1:], held[1:], strict=True)), YUV_WEIGHTS[0][0] * held[0])] * 3
    return tuple(F.round(x).cast("long") for x in held)


def parse_hex(text: Column, default: tuple[int, int, int]) -> Column:
    """'#RRGGBB' (the hash may be missing) as an array of three channels, or the default."""
    bare = F.regexp_replace(F.trim(text), "^#+", "")
    channels = F.array(*[F.conv(F.substring(bare, i, 2), 16, 10).cast("long") for i in (1, 3, 5)])
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), channels).otherwise(F.array(*[F.lit(d).cast("long") for d in default]))
