"""Operators on pixels in long form: one row per (video_id, idx, pos) with x, y and the channels r, g, b.

Long form keeps every step inside Catalyst.  It suits small regions; packed frames go through ``operators.packed``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColorSegment, Filter
from ..functions import colour

KEYS = ["video_id", "idx"]


def crop(pixels: DataFrame, width: int, height: int, up: int = 0, down: int = 0, left: int = 0, right: int = 0) -> DataFrame:
    """The rectangle that the margins leave, moved to the origin; margins are held within the frame, and it may be empty."""
    hold = lambda v, most: max(0, min(v, most))
    y0, x0 = hold(up, height), hold(left, width)
    y1, x1 = max(height - hold(down, height), y0), max(width - hold(right, width), x0)
    kept = pixels.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    moved = kept.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return moved.withColumn("pos", F.col("y") * (x1 - x0) + F.col("x"))


def scale_nearest(pixels: DataFrame, width: int, height: int, factor: float) -> DataFrame:
    """Nearest-neighbour scaling; a factor of 0 or less, or one that changes nothing, returns the pixels as they are.

    Each source pixel makes the target rows that read it: the inverse of the sampling rule, so nothing is joined.
    """
    new_w, new_h = int(width * factor), int(height * factor)
    if factor <= 0 or not new_w or not new_h or (new_w, new_h) == (width, height):
        return pixels
    sources = {}
    for axis, size, new in (("x", width, new_w), ("y", height, new_h)):
        back: list[list[int]] = [[] for _ in range(size)]
        for t in range(new):
            back[int(min(t / factor, size - 1))].append(t)
        sources[axis] = F.array(*[F.array(*[F.lit(t) for t in b]).cast("array<bigint>") for b in back])
    wide = pixels.withColumn("x", F.explode(F.get(sources["x"], F.col("x").cast("int"))))
    both = wide.withColumn("y", F.explode(F.get(sources["y"], F.col("y").cast("int"))))
    return both.withColumn("pos", F.col("y") * new_w + F.col("x"))


def sharpen(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Inner pixels move away from the mean of their four neighbours by three fifths; borders stay.

    Each pixel sends its channels to itself and its four neighbours, and one aggregation by place gathers them.
    """
    sent = pixels.withColumn("d", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])))
    own = (F.col("d.dx") == 0) & (F.col("d.dy") == 0)
    sent = sent.select(*KEYS, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), own.alias("own"), "r", "g", "b")
    sums = [a for c in "rgb" for a in (F.max(F.when(F.col("own"), F.col(c))).alias(c), F.sum(F.when(~F.col("own"), F.col(c))).alias(f"around_{c}"))]
    gathered = sent.groupBy(*KEYS, "x", "y").agg(*sums).filter("r is not null")
    inner = (F.col("x") > 0) & (F.col("x") < width - 1) & (F.col("y") > 0) & (F.col("y") < height - 1)

    def moved(c: str) -> Column:
        mean = F.call_function("div", F.col(f"around_{c}").cast("long"), F.lit(4).cast("long"))
        step = F.call_function("div", ((F.col(c) - mean) * 3).cast("long"), F.lit(5).cast("long"))
        return F.when(inner, F.least(F.greatest(F.col(c) + step, F.lit(0)), F.lit(255))).otherwise(F.col(c)).cast("long").alias(c)

    return gathered.select(*KEYS, (F.col("y") * width + F.col("x")).alias("pos"), "x", "y", *[moved(c) for c in "rgb"])


def segment_hit(segment: ColorSegment, r: Column, g: Column, b: Column) -> Column:
    """True where every enabled check of the segment holds; checks that are off never enter the plan."""
    checks = []
    if segment.enable_rgb:
        checks.append(colour.squared_distance((r, g, b), segment.rgb) <= segment.rgb_diff**2)
    hue, sat, lum = colour.hsv(r, g, b)
    if segment.enable_hue:
        checks.append(colour.hue_distance(hue, segment.hue) <= segment.hue_diff)
    if segment.enable_lum_min:
        checks.append(lum >= segment.lum_min)
    if segment.enable_lum_max:
        checks.append(lum <= segment.lum_max)
    if segment.enable_sat_min:
        checks.append(sat >= segment.sat_min)
    if segment.enable_sat_max:
        checks.append(sat <= segment.sat_max)
    return reduce(lambda a, c: a & c, checks, F.lit(True))


def filter_hit(cfg: Filter, r: Column, g: Column, b: Column) -> Column:
    """True where any active segment holds."""
    return reduce(or_, [segment_hit(s, r, g, b) for s in cfg.active_segments()])


def dilate(hits: DataFrame, width: int, height: int, times: int = 1) -> DataFrame:
    """Set pixels (video_id, idx, pos) grown by a square of 2 * times + 1, clipped at the border.

    times squares of three in a row are one square of 2 * times + 1, so one explode and one distinct do for any number.
    """
    if times <= 0:
        return hits.select(*KEYS, "pos").distinct()
    reach = F.sequence(F.lit(-times), F.lit(times))
    at = hits.select(*KEYS, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).alias("y"))
    at = at.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach))
    at = at.select(*KEYS, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    at = at.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return at.select(*KEYS, (F.col("y") * width + F.col("x")).cast("long").alias("pos")).distinct()


def mask_pixels(pixels: DataFrame, cfg: Filter, width: int, height: int) -> DataFrame:
    """Set pixels of the colour filter with its pixel compensation."""
    hits = pixels.filter(filter_hit(cfg, F.col("r"), F.col("g"), F.col("b"))).select(*KEYS, "pos")
    return dilate(hits, width, height, cfg.pixel_compensate) if cfg.pixel_compensate > 0 else hits


def bounding_box(hits: DataFrame, width: int, by: list[str] | None = None) -> DataFrame:
    """Smallest and largest x and y, width and height, and area of the set pixels of each group."""
    x, y = F.col("pos") % width, F.floor(F.col("pos") / width)
    box = hits.groupBy(*(by or KEYS)).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), F.count("*").alias("area"))
    return box.withColumns({"bw": F.col("max_x") - F.col("min_x") + 1, "bh": F.col("max_y") - F.col("min_y") + 1})


def crop_to_box(hits: DataFrame, width: int) -> DataFrame:
    """Set pixels moved to the origin of their frame's bounding box."""
    box = bounding_box(hits, width).select(*KEYS, "min_x", "min_y", "bw")
    x, y = F.col("pos") % width - F.col("min_x"), F.floor(F.col("pos") / width) - F.col("min_y")
    return hits.join(box, KEYS).select(*KEYS, (y * F.col("bw") + x).cast("long").alias("pos"))


def row_extents(hits: DataFrame, width: int) -> DataFrame:
    """First and last set x of each row that has one."""
    y = F.floor(F.col("pos") / width).alias("y")
    x = F.col("pos") % width
    return hits.groupBy(*KEYS, y).agg(F.min(x).alias("first_x"), F.max(x).alias("last_x"))


def frame_stats(pixels: DataFrame) -> DataFrame:
    """Number, mean, smallest and largest over all channel values of each frame."""
    values = pixels.select(*KEYS, F.explode(F.array("r", "g", "b")).alias("v"))
    return values.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def pick(pixels: DataFrame, x: Column, y: Column, width: int, height: int) -> DataFrame:
    """The pixel of each frame at x, y, held within the frame."""
    hold = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.lit(most - 1))
    return pixels.filter((F.col("x") == hold(x, width)) & (F.col("y") == hold(y, height)))


def compose(pixels: DataFrame, hits: DataFrame, mode: str, width: int) -> DataFrame:
    """Preview rows: raw, mask (white on black), overlay, or combo (overlay to the right of raw).

    The mode ocr, what would be exported, is a picture and no pixel rows: see ``sources.writers.previews``.
    """
    if mode == "ocr":
        raise ValueError("sources.writers.previews renders this mode")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    both = pixels.join(hits.select(*KEYS, "pos", F.lit(True).alias("hit")), [*KEYS, "pos"], "left")
    rgb = tuple(F.col(c) for c in "rgb")
    tinted = colour.overlay(hit, rgb)
    white = F.when(hit, 255).otherwise(0).cast("long")
    layers = {"raw": rgb, "mask": (white,) * 3, "overlay": tinted}
    row = lambda layer, shift: F.struct((F.col("x") + shift).cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[c.cast("long").alias(n) for c, n in zip(layers[layer], "rgb", strict=True)])
    shown = [row("raw", 0), row("overlay", width)] if mode == "combo" else [row(mode if mode in layers else "raw", 0)]
    return both.select(*KEYS, F.explode(F.array(*shown)).alias("p")).select(*KEYS, "p.*")


def remap(x: Column, y: Column, scale: float, origin: tuple[int, int], width: int, height: int) -> tuple[Column, Column]:
    """Region coordinates back on the frame: divided by the scale, rounded half away from zero, moved, held within."""
    back = lambda v, o, most: F.least(F.greatest(F.round(v / F.lit(scale)).cast("long") + o, F.lit(0)), F.lit(most - 1))
    return back(x, origin[0], width), back(y, origin[1], height)


def rotate(x: Column, y: Column, width: int, height: int, how: str) -> tuple[Column, Column]:
    """Where a pixel goes: cw, ccw, 180, flip_h or flip_v."""
    return {
        "cw": (height - 1 - y, x),
        "ccw": (y, width - 1 - x),
        "180": (width - 1 - x, height - 1 - y),
        "flip_h": (width - 1 - x, y),
        "flip_v": (x, height - 1 - y),
    }[how]
