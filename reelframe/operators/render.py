"""Rendering of subtitle tiles from masks, and image geometry, as numpy kernels behind Arrow passes."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import YUV_WEIGHTS, contrast_factor
from .components import label_places


def despeckle_array(mask: np.ndarray, min_area: int) -> np.ndarray:
    """The mask (h x w of bool) without components of at most min_area pixels."""
    if min_area <= 0 or not mask.any():
        return mask
    h, w = mask.shape
    places = np.flatnonzero(mask.ravel())
    comp, sizes = np.unique(label_places(places, w), return_inverse=True)
    keep = np.bincount(sizes, minlength=len(comp))[sizes] > min_area
    out = np.zeros(h * w, bool)
    out[places[keep]] = True
    return out.reshape(h, w)


def _bilinear(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """field (h x w [x c]) sampled at the grid y by x; coordinates are held within it."""
    h, w = field.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    extra = (1,) * (field.ndim - 2)
    fy, fx = (y - y0).reshape(-1, 1, *extra), (x - x0).reshape(1, -1, *extra)
    top = field[y0][:, x0] * (1 - fx) + field[y0][:, x1] * fx
    low = field[y1][:, x0] * (1 - fx) + field[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def supersampled(field: np.ndarray, scale: float, times: int) -> np.ndarray:
    """Mean of times x times bilinear samples for each pixel of the scaled picture."""
    h, w = field.shape[:2]
    dh, dw = max(int(h * scale + 0.5), 1), max(int(w * scale + 0.5), 1)
    total = 0.0
    for sy in range(times):
        for sx in range(times):
            y = (np.arange(dh) + (sy + 0.5) / times) / scale - 0.5
            x = (np.arange(dw) + (sx + 0.5) / times) / scale - 0.5
            total = total + _bilinear(field.astype(float), y, x)
    return total / (times * times)


def grow(cover: np.ndarray, radius: int) -> np.ndarray:
    """Largest value within a square of the radius (0 to 4), clipped at the border."""
    radius = max(0, min(radius, 4))
    h, w = cover.shape
    padded = np.pad(cover, radius)
    return np.max([padded[dy : dy + h, dx : dx + w] for dy in range(2 * radius + 1) for dx in range(2 * radius + 1)], axis=0)


def tile(mask: np.ndarray, image: np.ndarray | None = None, *, scale=1.0, mode="gray", antialias=True, supersample=3, dilate=0, gamma=0.85, threshold=0.5, despeckle=4, fg=(0, 0, 0), bg=(255, 255, 255)) -> np.ndarray | None:
    """RGB picture of a mask: coverage, grown strokes, then fore- and background mixed by it; None for an empty shape."""
    if not mask.size:
        return None
    scale, times = max(scale, 0.1), max(1, min(supersample, 4)) if antialias else 1
    # Nine places: ties at a threshold or half a level do not hang on the order of sums.
    cover = np.clip(np.round(supersampled(despeckle_array(mask, despeckle), scale, times), 9), 0, 1)
    cover = grow(cover, dilate)
    front = supersampled(image, scale, times) if mode == "color" and image is not None else np.array(fg, float)
    gamma = max(0.1, min(gamma, 4.0))
    if mode == "binary":
        alpha = (cover >= max(0.02, min(threshold, 0.98))).astype(float)
    else:
        alpha = cover if abs(gamma - 1) < 1e-6 else np.clip(cover**gamma, 0, 1)
    mixed = front * alpha[..., None] + np.array(bg, float) * (1 - alpha[..., None])
    return np.floor(np.clip(np.round(mixed, 9), 0, 255) + 0.5).astype(np.uint8)


def side_by_side(tiles: list[np.ndarray], gap: int = 4, bg=(255, 255, 255)) -> np.ndarray:
    """Tiles in a row with gaps before, between and after them, top-aligned."""
    out = np.empty((max(t.shape[0] for t in tiles), gap + sum(t.shape[1] + gap for t in tiles), 3), np.uint8)
    out[:] = bg
    x = gap
    for t in tiles:
        out[: t.shape[0], x : x + t.shape[1]] = t
        x += t.shape[1] + gap
    return out


def blank_split(image: np.ndarray, bg=(255, 255, 255), tolerance: int = 12) -> int | None:
    """The row in the middle of the longest run of blank rows, if it lies strictly within the middle half.

    A row is blank when all its channels are within tolerance of the background; fewer than three blank rows are none.
    """
    blank = (np.abs(image.astype(int) - np.array(bg)) <= tolerance).all(axis=(1, 2))
    if blank.sum() < 3:
        return None
    edges = np.flatnonzero(np.diff(np.r_[0, blank.astype(int), 0]))
    starts, ends = edges[::2], edges[1::2]
    k = int((ends - starts).argmax())
    middle, h = int(starts[k] + ends[k] - 1) // 2, len(blank)
    return middle if h // 4 < middle < 3 * h // 4 else None


def turn(image: np.ndarray, how: str) -> np.ndarray:
    return {"cw": lambda a: np.rot90(a, -1), "ccw": lambda a: np.rot90(a), "180": lambda a: a[::-1, ::-1], "flip_h": lambda a: a[:, ::-1], "flip_v": lambda a: a[::-1]}[how](image)


def trim_and_pad(image: np.ndarray, ocr, bg=(255, 255, 255)) -> np.ndarray:
    """A tile without the configured margins (at least one pixel stays) and with padding of the background."""
    h, w = image.shape[:2]
    y0, x0 = min(max(ocr.crop_top, 0), h - 1), min(max(ocr.crop_left, 0), w - 1)
    y1, x1 = max(h - max(ocr.crop_bottom, 0), y0 + 1), max(w - max(ocr.crop_right, 0), x0 + 1)
    cut, pad = image[y0:y1, x0:x1], max(ocr.padding, 0)
    out = np.empty((cut.shape[0] + 2 * pad, cut.shape[1] + 2 * pad, 3), np.uint8)
    out[:] = bg
    out[pad : pad + cut.shape[0], pad : pad + cut.shape[1]] = cut
    return out


def toned(image: np.ndarray, brightness: int, contrast: int, grey: bool) -> np.ndarray:
    v = np.clip(contrast_factor(contrast) * (image.astype(float) - 128.0) + 128.0 + max(-100, min(100, brightness)), 0, 255)
    if grey:
        v = np.repeat((v @ np.array(YUV_WEIGHTS[0]))[..., None], 3, axis=2)
    return np.floor(v + 0.5).astype(np.uint8)


#: Reach and weight of each resampling filter.
KERNELS = {
    "nearest": (0.5, lambda x: (np.abs(x) <= 0.5).astype(float)),
    "triangle": (1.0, lambda x: np.maximum(1 - np.abs(x), 0)),
    "catmullrom": (2.0, lambda x: np.where(np.abs(x) < 1, 1.5 * np.abs(x) ** 3 - 2.5 * x**2 + 1, np.where(np.abs(x) < 2, -0.5 * np.abs(x) ** 3 + 2.5 * x**2 - 4 * np.abs(x) + 2, 0))),
    "gaussian": (3.0, lambda x: np.exp(-(x**2) / (2 * 0.5**2))),
    "lanczos3": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def resized(image: np.ndarray, width: int, height: int, how: str = "lanczos3") -> np.ndarray:
    """Separable resampling; the filter widens when the picture shrinks."""

    def along(old: int, new: int) -> np.ndarray:
        ratio, (reach, weight) = old / new, KERNELS.get(how, KERNELS["lanczos3"])
        wide = max(ratio, 1.0)
        centre = (np.arange(new) + 0.5) * ratio
        if how == "nearest":
            return np.eye(old)[np.minimum(centre.astype(int), old - 1)]
        distance = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / wide
        w = np.where(np.abs(distance) <= reach, weight(distance), 0.0)
        return w / w.sum(1, keepdims=True)

    h, w = image.shape[:2]
    out = np.einsum("yh,hwc,xw->yxc", along(h, height), image.astype(float), along(w, width), optimize=True)
    return np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8)


def finished(image: np.ndarray, ocr) -> np.ndarray:
    """The canvas turned, mirrored, toned and held to the largest width, in this order."""
    how = {90: "cw", 180: "180", 270: "ccw"}.get(ocr.rotate % 360)
    image = turn(image, how) if how else image
    image = turn(image, "flip_h") if ocr.flip_h else image
    image = turn(image, "flip_v") if ocr.flip_v else image
    if ocr.brightness or ocr.contrast or ocr.grayscale:
        image = toned(image, ocr.brightness, ocr.contrast, ocr.grayscale)
    h, w = image.shape[:2]
    if 0 < ocr.max_width < w:
        image = resized(image, ocr.max_width, max(int(h * (ocr.max_width / w) + 0.5), 1), ocr.scale_filter.strip().lower())
    return np.ascontiguousarray(image)


def halves(image: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows above y and from y on, at least one each."""
    return image[: max(y, 1)], image[min(y, len(image) - 1) :]


def png(image: np.ndarray) -> bytes:
    """An RGB picture as a PNG file."""
    h, w, _ = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.hstack([np.zeros((h, 1), np.uint8), image.reshape(h, -1)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(image: np.ndarray) -> bytes:
    """An RGB picture as a 24-bit BMP file."""
    h, w, _ = image.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def simplify(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """Ramer-Douglas-Peucker with distances to the segment, by an explicit stack."""
    if len(points) <= 2:
        return list(points)
    p = np.array(points, float)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, own = p[b] - p[a], p[a + 1 : b] - p[a]
        square = line @ line
        t = np.clip(own @ line / square, 0, 1) if square > 1e-9 else np.zeros(len(own))
        d = np.hypot(*(own - t[:, None] * line).T)
        far = int(d.argmax())
        if d[far] > tolerance:
            middle = a + 1 + far
            keep[middle] = True
            stack += [(a, middle), (middle, b)]
    return [points[i] for i in np.flatnonzero(keep)]


def outlines(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed silhouettes of components at least three rows high: left ends downwards, right ends upwards."""
    h, w = mask.shape
    places = np.flatnonzero(mask.ravel())
    if not len(places):
        return []
    comp = label_places(places, w)
    out = []
    for c in np.unique(comp):
        own = places[comp == c]
        y, x = own // w, own % w
        rows = np.unique(y)
        if len(rows) < 3:
            continue
        first = np.full(h, w)
        last = np.full(h, -1)
        np.minimum.at(first, y, x)
        np.maximum.at(last, y, x)
        shape = simplify([(int(first[r]), int(r)) for r in rows], 0.5) + simplify([(int(last[r]), int(r)) for r in rows], 0.5)[::-1]
        if shape[0] != shape[-1]:
            shape.append(shape[0])
        if len(shape) >= 4:
            out.append(shape)
    return out


def polygon(mask: np.ndarray, tolerance: float = 1.2) -> str:
    """Drawing commands of the mask's silhouettes, '' if there are none."""
    parts = []
    for shape in outlines(mask):
        s = simplify(shape, tolerance)
        if len(s) >= 3:
            parts.append("m " + " l ".join(f"{x:.1f} {y:.1f}" for x, y in [*s, s[0]]))
    return "{\\p1}" + " ".join(parts) + "{\\p0}" if parts else ""


# ---- pictures as rows ----

#: Bytes of input up to which a result is remembered: such pictures cost calls, not pixels, and repeat.
SMALL = 4096


def remembered(kernel):
    """kernel(size, *values) that keeps its latest 4096 results for inputs of at most SMALL bytes (size); others are made anew.

    To be made within a task; values must be hashable, and results must not be changed.
    """
    kept = lru_cache(4096)(kernel)
    return lambda size, *values: (kept if size <= SMALL else kernel)(*values)


def colour_of(code: str, default: tuple[int, int, int]) -> tuple[int, int, int]:
    """'#RRGGBB' (the hash may be missing) as channels, or the default."""
    t = code.strip().lstrip("#")
    return tuple(int(t[i : i + 2], 16) for i in (0, 2, 4)) if len(t) == 6 and all(c in "0123456789abcdefABCDEF" for c in t) else default


def bare(mask: np.ndarray, image: bytes | None, ocr) -> np.ndarray:
    """The rendered tile of a mask; image has the mask's colours, for mode color."""
    fg, bg = colour_of(ocr.text_color, (0, 0, 0)), colour_of(ocr.bg_color, (255, 255, 255))
    own = np.frombuffer(image, np.uint8).reshape(*mask.shape, 3) if image and len(image) == mask.size * 3 else None
    return tile(mask, own, scale=ocr.scale, mode=ocr.color_mode.strip().lower(), antialias=ocr.antialias, supersample=ocr.supersample, dilate=ocr.stroke_dilate, gamma=ocr.coverage_gamma, threshold=ocr.binary_threshold, despeckle=ocr.despeckle_min_area, fg=fg, bg=bg)


def in_colour(ocr) -> bool:
    """Whether tiles show the image's colours; else they hang on the mask alone."""
    return ocr.color_mode.strip().lower() == "color"


def picture(mask: np.ndarray, image: bytes | None, ocr) -> np.ndarray:
    """The rendered tile with its margins cut and padding added."""
    return trim_and_pad(bare(mask, image, ocr), ocr, colour_of(ocr.bg_color, (255, 255, 255)))


def _images(rows: DataFrame, columns: list[str], kernel, more: str = "") -> DataFrame:
    """kernel(values of columns) -> list of (RGB array, *values of more), as rows of video_id, idx, rgb, width, height and more."""
    source = rows.select("video_id", "idx", *columns)
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in ("video_id", "idx"))
    names = [m.split()[0] for m in more.split(", ") if m]

    def run(batches):
        for b in batches:
            made = [(k, *out) for k, values in enumerate(zip(*[b.column(c).to_pylist() for c in columns], strict=True)) for out in kernel(*values)]
            of = pa.array([m[0] for m in made], pa.int32())
            arrays = [pa.array([np.ascontiguousarray(m[1]).tobytes() for m in made], pa.binary()), *[pa.array([m[1].shape[i] for m in made], pa.int32()) for i in (1, 0)], *[pa.array([m[2 + i] for m in made], pa.string()) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays([b.column("video_id").take(of), b.column("idx").take(of), *arrays], ["video_id", "idx", "rgb", "width", "height", *names])

    return source.mapInArrow(run, f"{kinds}, rgb binary, width int, height int" + (f", {more}" if more else ""))


def pictures(frames: DataFrame, ocr) -> DataFrame:
    """The rendered region of each frame that has a mask: frames with mask (``masks.Packed``), roi_w, roi_h and roi or not."""
    from .masks import Packed

    columns = ["mask", "roi_w", "roi_h", *[c for c in ("roi",) if c in frames.columns]]
    return _images(frames, columns, lambda bits, w, h, roi=None: [(picture(Packed.unpack(bits, w, h), roi, ocr),)] if bits else [])


def edited(frames: DataFrame, ocr) -> DataFrame:
    """Frames with margins cut, padding added, turned, mirrored, toned and held to the largest width."""
    bg = colour_of(ocr.bg_color, (255, 255, 255))
    return _images(frames, ["rgb", "width", "height"], lambda rgb, w, h: [(finished(trim_and_pad(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), ocr, bg), ocr),)])


def split(frames: DataFrame) -> DataFrame:
    """Frames cut at their split_y: rows with half, top or bottom."""

    def kernel(rgb, w, h, y):
        return list(zip(halves(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), y), ("top", "bottom"), strict=True))

    return _images(frames.withColumn("split_y", F.col("split_y").cast("int")), ["rgb", "width", "height", "split_y"], kernel, "half string")
