"""Operators on packed frames (rgb BINARY, row-major, three bytes a pixel) through numpy kernels behind Arrow.

The long form multiplies a frame by its pixels; real frame sizes stay packed, and masks leave the kernels with one bit a
pixel.  A frame meets the one before it where both are read: partitions are read in frame order, and only the frames at
the borders of partitions are exchanged (``compared``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, Filter, Postprocess
from ..shared import stored
from .components import label_places
from .masks import Packed
from .pixel import KEYS


def frame_array(rgb: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8, width * height * 3).reshape(height, width, 3)


def to_pixels(frames: DataFrame) -> DataFrame:
    """Long form of packed frames, in Catalyst: hex pairs of each place."""
    places = frames.select(*KEYS, "width", F.hex("rgb").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)).alias("pos"))
    channel = lambda k: F.conv(F.substring(F.col("h"), (F.col("pos") * 6 + 1 + 2 * k).cast("int"), F.lit(2)), 16, 10).cast("long")
    return places.select(*KEYS, "pos", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).alias("y"), *[channel(k).alias(c) for k, c in enumerate("rgb")])


def unpadded(frames: DataFrame, stride: Column) -> DataFrame:
    """Frames whose rows take stride bytes each, as packed ones; bytes beyond a row's pixels are dropped."""
    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.hex(F.substring(F.col("rgb"), y * stride + 1, F.col("width") * 3)))
    return frames.withColumn("rgb", F.when(F.col("height") > 0, F.unhex(F.array_join(rows, ""))).otherwise(F.lit(b"")))


# ---- kernels on one frame ----


def crop_array(rgb: np.ndarray, cfg: Config) -> tuple[np.ndarray, int, int]:
    """The region that the margins leave, and its origin in the frame."""
    h, w = rgb.shape[:2]
    hold = lambda v, most: max(0, min(v, most))
    r = cfg.region
    y0, x0 = hold(r.up, h), hold(r.left, w)
    return rgb[y0 : max(h - hold(r.down, h), y0), x0 : max(w - hold(r.right, w), x0)], x0, y0


def scale_array(rgb: np.ndarray, factor: float) -> np.ndarray:
    """Nearest-neighbour scaling; a factor that leaves nothing or changes nothing returns the frame as it is."""
    h, w = rgb.shape[:2]
    new_h, new_w = int(h * factor), int(w * factor)
    if factor <= 0 or not new_h or not new_w or (new_h, new_w) == (h, w):
        return rgb
    at = lambda new, size: np.minimum(np.arange(new) / factor, size - 1).astype(np.intp)
    return rgb[at(new_h, h)[:, None], at(new_w, w)]


def sharpen_array(rgb: np.ndarray) -> np.ndarray:
    """Inner pixels move away from the mean of their four neighbours by three fifths; borders stay."""
    if min(rgb.shape[:2]) < 3:
        return rgb
    v = rgb.astype(np.int16)
    inner = v[1:-1, 1:-1]
    away = (inner - ((v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:]) >> 2)) * 3
    out = rgb.copy()
    out[1:-1, 1:-1] = np.clip(inner + np.sign(away) * (np.abs(away) // 5), 0, 255)
    return out


def region(rgb: np.ndarray, cfg: Config) -> tuple[np.ndarray, int, int]:
    """What a rip works on: the frame's region, scaled and sharpened, and its origin in the frame."""
    out, x0, y0 = crop_array(rgb, cfg)
    factor = cfg.region.scale * max(cfg.preview.scale_video, 0.05)
    if factor > 0 and abs(factor - 1.0) > 1e-6:
        out = scale_array(out, factor)
    if cfg.region.sharpen or cfg.preview.sharpen_video:
        out = sharpen_array(out)
    return np.ascontiguousarray(out), x0, y0


def hsv_arrays(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    top = np.maximum(np.maximum(r, g), b)
    spread = top - np.minimum(np.minimum(r, g), b)
    safe = np.maximum(spread, 1)
    part = np.where(r == top, g - b, np.where(g == top, b - r, r - g)) * 60
    base = np.where(r == top, 0, np.where(g == top, 120, 240))
    hue = np.where(spread == 0, 0, np.sign(part) * (np.abs(part) // safe) + base)
    return np.where(hue < 0, hue + 360, hue), np.where(top == 0, 0, spread * 255 // np.maximum(top, 1)), top


def near_colour(rgb: np.ndarray, to: tuple[int, int, int], within: int) -> np.ndarray:
    """Pixels at most so far from a colour.  One channel alone rules most pixels out; the rest is computed for the others."""
    if within < 0:  # only the square counts
        within = -within
    first = rgb[..., 1]
    low, high = to[1] - within, to[1] + within
    hit = np.ones(first.shape, bool)
    if low > 0:
        hit &= first >= min(low, 256)
    if high < 255:
        hit &= first <= max(high, -1)
    places = np.flatnonzero(hit.ravel())
    away = rgb.reshape(-1, 3)[places].astype(np.int32) - np.array(to, np.int32)
    hit.ravel()[places[(away * away).sum(1) > within * within]] = False
    return hit


def dilate_array(hit: np.ndarray, times: int) -> np.ndarray:
    """Grown by a square of 2 * times + 1, clipped at the border: rows first, then columns."""
    for axis in (0, 1):
        for _ in range(times):
            grown = hit.copy()
            ahead, back = (slice(1, None), slice(None, -1)) if axis == 0 else ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))
            grown[ahead] |= hit[back]
            grown[back] |= hit[ahead]
            hit = grown
    return hit


def filter_array(rgb: np.ndarray, cfg: Filter) -> np.ndarray:
    """Mask (h x w) of the colour filter with its pixel compensation."""
    hit = np.zeros(rgb.shape[:2], bool)
    hsv = None
    for s in cfg.active_segments():
        own = near_colour(rgb, s.rgb, s.rgb_diff) if s.enable_rgb else np.ones_like(hit)
        if s.enable_hue or s.enable_lum_min or s.enable_lum_max or s.enable_sat_min or s.enable_sat_max:
            hsv = hsv or hsv_arrays(rgb)
            if s.enable_hue:
                d = np.abs(hsv[0] // 2 - s.hue % 180)
                own &= np.minimum(d, 180 - d) <= s.hue_diff
            for on, value, low, high in ((s.enable_lum_min, hsv[2], s.lum_min, None), (s.enable_lum_max, hsv[2], None, s.lum_max), (s.enable_sat_min, hsv[1], s.sat_min, None), (s.enable_sat_max, hsv[1], None, s.sat_max)):
                if on:
                    own &= value >= low if high is None else value <= high
        hit |= own
    return dilate_array(hit, max(cfg.pixel_compensate, 0))


def clean_array(mask: np.ndarray, cfg: Postprocess) -> np.ndarray:
    """The mask without the components that the clean-up rules drop."""
    h, w = mask.shape
    places = np.flatnonzero(mask.ravel())
    if not len(places):
        return mask
    _, of = np.unique(label_places(places, w), return_inverse=True)
    n, x, y = of.max() + 1, places % w, places // w
    area = np.bincount(of, minlength=n)
    order, starts = np.argsort(of, kind="stable"), np.cumsum(area) - area
    low = lambda v: np.minimum.reduceat(v[order], starts)
    high = lambda v: np.maximum.reduceat(v[order], starts)
    x0, x1, y0, y1 = low(x), high(x), low(y), high(y)
    bad = np.zeros(n, bool)
    if cfg.single_dot:
        bad |= area == 1
    if cfg.single_line:
        bad |= (area <= 4) & ((x0 == x1) | (y0 == y1))
    if cfg.large_block > 0:
        bad |= area > cfg.large_block
    if cfg.touch_edge:
        bad |= (x0 == 0) | (y0 == 0) | (x1 == w - 1) | (y1 == h - 1)
    if cfg.pass_center:
        bad |= (y0 < int(h * (0.5 - cfg.center_tolerance))) & (y1 > int(h * (0.5 + cfg.center_tolerance)))
    out = np.zeros(h * w, bool)
    out[places[~bad[of]]] = True
    return out.reshape(h, w)


def changed_array(now: np.ndarray, then: np.ndarray, threshold: int) -> np.ndarray:
    """Pixels of which a channel differs by more than the threshold."""
    if threshold < 0:
        return np.ones(now.shape[:2], bool)
    return (np.maximum(now, then) - np.minimum(now, then)).max(-1) > threshold


def colours_array(rgb: np.ndarray, changed: np.ndarray) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Main and outline colour of the changed pixels, as ``detect.auto_colours``: sorted by r + g + b, equal ones by place."""
    points = rgb[changed]
    n = len(points)
    if n < 16:
        return (255, 255, 255), (0, 0, 0)
    order = np.argsort(points.sum(1, dtype=np.uint16), kind="stable")
    median = lambda part: tuple(int(v) for v in np.partition(points[part], len(part) // 2, axis=0)[len(part) // 2])
    return median(order[n * 85 // 100 :]), median(order[: max(n * 15 // 100, 1)])


def plausible_colours(main: tuple, outline: tuple) -> bool:
    return sum(main) / 3.0 >= 155.0 and sum(outline) / 3.0 <= 95.0


# ---- frames beside the frame before ----

_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list, types: list, names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def compared(frames: DataFrame, cfg: Config, make: Callable, fields: str) -> DataFrame:
    """One row for each frame that has one before it in its video and for which make returns values, stored.

    frames: video_id, idx, rgb, width, height, with one row a frame, and time or not.  make() runs once per task and
    returns a function of (video, idx, time, region, region before, origin) to a tuple of the values of fields, or None.
    A region of another size than the one before it is compared with nothing.  The column frames counts the frames read
    since the last row of the same task and video; a task's last row of a video may have nothing but that count.

    Partitions are put in frame order where they are.  If they hold separate ranges of every video, only each range's first
    and last region are exchanged; if not, the frames are first partitioned by range.  Frames of a source with a halo
    (``sources.frames``) exchange nothing.
    """
    parts = [f.split(":") for f in fields.split(";")]
    names = [n for n, _ in parts]
    has_halo = "halo" in frames.columns
    time = F.col("time") if "time" in frames.columns else F.lit(None)
    source = frames.select(*KEYS, time.cast("double").alias("time"), "rgb", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *(["halo"] if has_halo else []))
    video, at = source.schema["video_id"].dataType, source.schema["idx"].dataType
    head = f"video_id {video.simpleString()}, idx {at.simpleString()}, time double, frames bigint"
    edge = "role string, edge_w int, edge_h int, edge_x int, edge_y int, edge binary"
    schema = f"{head}, {', '.join(f'{n} {k}' for n, k in parts)}, {edge}"
    edges_types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    blank, none = (None,) * len(parts), (None,) * 6

    def local(batches):
        work, last, read, types, all_names = make(), None, 0, None, None  # last: (video, idx, time, region, x0, y0)

        def edge_row(role):
            v, i, t, own, x0, y0 = last
            return (v, i, t, 0, *blank, role, own.shape[1], own.shape[0], x0, y0, own.tobytes())

        for b in batches:
            types = [b.schema.field("video_id").type, b.schema.field("idx").type, pa.float64(), pa.int64(), *[_TYPES[k] for _, k in parts], *edges_types]
            all_names = [*KEYS, "time", "frames", *names, "role", "edge_w", "edge_h", "edge_x", "edge_y", "edge"]
            columns = [b.column(c) for c in ("video_id", "idx", "time", "rgb", "width", "height", *(["halo"] if has_halo else []))]
            for k in range(b.num_rows):
                v, i, t, rgb, w, h, *halo = (c[k].as_py() for c in columns)
                own, x0, y0 = region(frame_array(rgb, w, h), cfg)
                out = []
                if last is not None and last[0] != v:
                    out = [] if has_halo else [edge_row("last")]
                    out.append((last[0], last[1], None, read, *blank, *none))
                    read = 0
                new = last is None or last[0] != v
                before, last = None if new else last[3], (v, i, t, own, x0, y0)
                if new and not has_halo:
                    out.append(edge_row("first"))
                if not (halo and halo[0]):
                    read += 1
                    values = work(v, i, t, own, before, x0, y0) if before is not None and before.shape == own.shape else None
                    if values is not None:
                        out.append((v, i, t, read, *values, *none))
                        read = 0
                if out:
                    yield _batch(out, types, all_names)
        if last is not None:
            out = [] if has_halo else [edge_row("last")]
            yield _batch([*out, (last[0], last[1], None, read, *blank, *none)], types, all_names)

    def border(batches):
        work, last = make(), None
        for b in batches:
            types = [b.schema.field("video_id").type, b.schema.field("idx").type, pa.float64(), pa.int64(), *[_TYPES[k] for _, k in parts]]
            for r in b.to_pylist():
                own = frame_array(r["edge"], r["edge_w"], r["edge_h"])
                if last is not None and last[0] == r["video_id"] and last[2] == r["role"]:  # two ranges are mixed
                    yield _batch([(r["video_id"], r["idx"], r["time"], -1, *blank)], types, [*KEYS, "time", "frames", *names])
                if r["role"] == "first" and last is not None and last[0] == r["video_id"] and last[1].shape == own.shape:
                    values = work(r["video_id"], r["idx"], r["time"], own, last[1], r["edge_x"], r["edge_y"])
                    if values is not None:
                        yield _batch([(r["video_id"], r["idx"], r["time"], 0, *values)], types, [*KEYS, "time", "frames", *names])
                last = (r["video_id"], own, r["role"])

    kept = [*KEYS, "time", "frames", *names]
    if has_halo:
        return stored(source.mapInArrow(local, schema), "compared").select(kept)
    plain = f"{head}, {', '.join(f'{n} {k}' for n, k in parts)}"

    def ranges(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the tasks found, and what the borders of their ranges add.  In frame order a video's borders alternate: first,
        last, first, last; a range of one frame has both at one place."""
        found = stored(ordered.mapInArrow(local, schema), "compared")
        ends = found.filter("role is not null").select(*KEYS, "time", "role", "edge_w", "edge_h", "edge_x", "edge_y", "edge")
        return found, stored(ends.repartition("video_id").sortWithinPartitions(*KEYS, "role").mapInArrow(border, plain), "borders")

    found, at_borders = ranges(source.sortWithinPartitions(*KEYS))
    if not at_borders.filter("frames < 0").isEmpty():
        spread = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found, at_borders = ranges(source.repartitionByRange(spread, *KEYS).sortWithinPartitions(*KEYS))
    return found.filter("role is null").select(kept).unionByName(at_borders.select(kept))


def filter_masks(frames: DataFrame, cfg: Filter, post: Postprocess) -> DataFrame:
    """Cleaned filter mask of each frame, one bit a pixel; null where it is empty."""
    source = frames.select(*KEYS, "rgb", "width", "height")
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in KEYS)

    def run(batches):
        for b in batches:
            masks = [Packed.pack(clean_array(filter_array(frame_array(rgb.as_py(), w.as_py(), h.as_py()), cfg), post)) for rgb, w, h in zip(b.column("rgb"), b.column("width"), b.column("height"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in KEYS], pa.array(masks, pa.binary())], [*KEYS, "mask"])

    return source.mapInArrow(run, f"{kinds}, mask binary")


def frame_differences(frames: DataFrame, threshold: int = 24, cfg: Config | None = None) -> DataFrame:
    """Changed pixels (number and mask), pixels and ratio of each frame that has one before it."""

    def make():
        def work(video, idx, time, own, before, x0, y0):
            changed = changed_array(own, before, threshold)
            n, area = int(changed.sum()), changed.size
            return n, area, n / area if area else 0.0, Packed.pack(changed)

        return work

    found = compared(frames, cfg or Config(), make, "changed:bigint;n:bigint;ratio:double;change_mask:binary")
    return found.filter("n is not null").select(*KEYS, "changed", "n", "ratio", "change_mask")
