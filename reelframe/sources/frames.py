"""Data sources for uncompressed frames: ``spark.read.format("rawframes" or "y4m").option("path", ...).load()``.

rawframes: packed RGB24 frames one after the other, described by options or by the file's name,
``<anything>_<width>x<height>_<fps>.rgb``.  y4m: YUV4MPEG2 files (``*.y4m``) of 8 bits, 4:2:0, 4:2:2, 4:4:4 or mono, whose
header says size and rate; chroma is interpolated and turned into RGB24.  Other codecs need a decoder that writes either.

Options: start and end (frames) or start_seconds and end_seconds, step, framesPerPartition, and halo: with it every
partition begins with the sampled frame before its own ones, marked in the column halo, so that differences need no
exchange.
"""

from __future__ import annotations

import glob
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config

SCHEMA = "video_id string, idx bigint, time double, width int, height int, rgb binary"
_NAME = re.compile(r"_(\d+)x(\d+)_(\d+(?:\.\d+)?)\.rgb$")
#: Sizes of a chroma plane in parts of the luma plane's width and height, by the first letters of the header's C field.
CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


class Clip:
    """Where the frames of a file are: offset + i * stride, each of size bytes."""

    def __init__(self, path: str, width: int, height: int, fps: float, offset: int, stride: int, size: int, chroma: str = "", full: bool = False):
        self.path, self.width, self.height, self.fps = path, width, height, fps
        self.offset, self.stride, self.size, self.chroma, self.full = offset, stride, size, chroma, full
        self.frames = max(os.path.getsize(path) - offset, 0) // stride if stride else 0

    def info(self) -> dict:
        return {"path": self.path, "width": self.width, "height": self.height, "fps": self.fps, "frame_count": self.frames, "duration_s": self.frames / self.fps}


def raw_clip(path: str, options) -> Clip:
    named = _NAME.search(path)
    width, height = int(options.get("width", named[1] if named else 0)), int(options.get("height", named[2] if named else 0))
    size = width * height * 3
    return Clip(path, width, height, float(options.get("fps", named[3] if named else 25.0)), 0, size, size)


def y4m_clip(path: str, options) -> Clip:
    """Reads the header line; a rate that is missing or outside 1..1000 is 25."""
    with open(path, "rb") as f:
        head = f.readline(4096)
        if not head.startswith(b"YUV4MPEG2"):
            raise ValueError(f"{path} is not a YUV4MPEG2 file")
        frame = f.readline(4096)
    fields = {p[:1]: p[1:] for p in head.decode("ascii", "replace").split()[1:] if p[:1] != "X"}
    width, height = int(fields["W"]), int(fields["H"])
    kind = fields.get("C", "420")
    chroma = next((c for c in CHROMA if kind.startswith(c)), None)
    if chroma is None or re.search(r"p\d+$|mono\d", kind):
        raise ValueError(f"{path}: {kind} is not supported")
    over, _, under = fields.get("F", "25:1").partition(":")
    fps = float(over) / float(under or 1) if float(under or 1) else 0.0
    parts = CHROMA[chroma]
    size = width * height + (2 * -(-width // parts[0]) * -(-height // parts[1]) if parts else 0)
    return Clip(path, width, height, fps if 1 <= fps <= 1000 else 25.0, len(head), len(frame or b"FRAME\n") + size, size, chroma, b"XCOLORRANGE=FULL" in head)


def _widened(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A chroma plane at the size of the luma plane, by linear interpolation between the centres of its samples."""
    for axis, size in ((0, height), (1, width)):
        n = plane.shape[axis]
        if n == size:
            continue
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5 if size % n == 0 else (np.arange(size) - 0.5) / 2, 0, n - 1)
        low = np.floor(at).astype(np.intp)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1)).astype(np.float32)
        plane = np.take(plane, low, axis) * (1 - share) + np.take(plane, np.minimum(low + 1, n - 1), axis) * share
    return plane


def to_rgb(data: bytes, clip: Clip) -> bytes:
    """Planar YUV as packed RGB24."""
    w, h = clip.width, clip.height
    values = np.frombuffer(data, np.uint8)
    luma, parts = values[: w * h].reshape(h, w).astype(np.float32), CHROMA[clip.chroma]
    # The standard-definition matrix, for studio or for full range.
    low, gain, wide = (0, 1.0, 1.0) if clip.full else (16, 255 / 219, 255 / 224)
    luma = (luma - low) * gain
    if parts is None:
        return np.repeat(np.clip(np.rint(luma), 0, 255).astype(np.uint8)[..., None], 3, axis=2).tobytes()
    cw, ch = -(-w // parts[0]), -(-h // parts[1])
    u, v = (_widened((values[w * h + k * cw * ch : w * h + (k + 1) * cw * ch].reshape(ch, cw).astype(np.float32) - 128) * wide, h, w) for k in (0, 1))
    rgb = np.stack([luma + 1.402 * v, luma - 0.344136 * u - 0.714136 * v, luma + 1.772 * u], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8).tobytes()


class FrameRange(InputPartition):
    """Frames of numbers: those to return, and the one before them or None."""

    def __init__(self, clip: Clip | None, numbers: range, before: int | None):
        super().__init__(None)
        self.clip, self.numbers, self.before = clip, numbers, before


class FrameReader(DataSourceReader):
    """Partitions are frame ranges, so reading is parallel within a file; start, end and step select frames at the source."""

    def __init__(self, options, pattern: str, probe):
        self.options, self.pattern, self.probe = options, pattern, probe
        self.halo = str(options.get("halo", "false")).lower() == "true"

    def partitions(self):
        o, out = self.options, []
        per, step = int(o.get("framesPerPartition", 256)), int(o.get("step", 1))
        paths = glob.glob(os.path.join(o["path"], self.pattern)) if os.path.isdir(o["path"]) else glob.glob(o["path"])
        for path in sorted(paths):
            clip = self.probe(path, o)
            start, end = int(o.get("start", 0)), int(o.get("end", clip.frames))
            if "start_seconds" in o or "end_seconds" in o:
                start, end = Config(start_seconds=float(o.get("start_seconds", 0)), end_seconds=float(o.get("end_seconds", 0))).frame_range(clip.fps, clip.frames)
            numbers = range(max(start, 0), min(end, clip.frames), max(step, 1))
            out += [FrameRange(clip, numbers[k : k + per], numbers[k - 1] if k else None) for k in range(0, len(numbers), per)]
        return out or [FrameRange(None, range(0), None)]

    def read(self, p: FrameRange):
        if p.clip is None:
            return
        clip, name = p.clip, os.path.basename(p.clip.path)
        with open(clip.path, "rb") as f:
            for i in [*([p.before] if self.halo and p.before is not None else []), *p.numbers]:
                head = clip.stride - clip.size
                f.seek(clip.offset + i * clip.stride)
                if head and not f.read(head).startswith(b"FRAME"):
                    raise ValueError(f"{clip.path}: frame {i} is not where frames of one size would have it")
                data = f.read(clip.size)
                row = name, i, i / clip.fps, clip.width, clip.height, to_rgb(data, clip) if clip.chroma else data
                yield (*row, i == p.before) if self.halo else row


class RawFrames(DataSource):
    @classmethod
    def name(cls):
        return "rawframes"

    def schema(self):
        return SCHEMA + (", halo boolean" if str(self.options.get("halo", "false")).lower() == "true" else "")

    def reader(self, schema):
        return FrameReader(self.options, "*.rgb", raw_clip)


class Y4MFrames(RawFrames):
    @classmethod
    def name(cls):
        return "y4m"

    def reader(self, schema):
        return FrameReader(self.options, "*.y4m", y4m_clip)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFrames)
    spark.dataSource.register(Y4MFrames)


def kind_of(path: str) -> str:
    """y4m for such a file or a folder that has one, else rawframes."""
    return "y4m" if path.endswith(".y4m") or glob.glob(os.path.join(path, "*.y4m")) else "rawframes"


def clips(path: str, **options) -> list[Clip]:
    """What the headers, or names, of the files under path say."""
    pattern, probe = ("*.y4m", y4m_clip) if kind_of(path) == "y4m" else ("*.rgb", raw_clip)
    found = glob.glob(os.path.join(path, pattern)) if os.path.isdir(path) else glob.glob(path)
    return [probe(p, options) for p in sorted(found)]


def load(spark: SparkSession, path: str, cfg: Config, **options) -> DataFrame:
    """Frames of the files under path in the range and steps of the configuration, each partition with its halo."""
    register(spark)
    read = spark.read.format(kind_of(path)).option("path", path).option("halo", "true").option("step", str(max(cfg.rip.frame_skip, 1)))
    if cfg.start_seconds or cfg.end_seconds:
        read = read.option("start_seconds", str(cfg.start_seconds)).option("end_seconds", str(cfg.end_seconds))
    for name, value in options.items():
        read = read.option(name, str(value))
    return read.load()
