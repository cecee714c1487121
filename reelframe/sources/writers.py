"""Artifacts as rows (video_id, name, content BINARY), made where their event rows are.

Events are a rip's, with mask (``masks.Packed``), roi_w, roi_h, roi_origin, bbox and image.  ``sources.files`` writes the
rows as files.
"""

from __future__ import annotations

import struct
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.colour import YUV_WEIGHTS
from ..operators import artifacts, render
from ..operators.masks import Packed
from ..shared import stored
from .jpeg import jpeg

FIELDS = "video_id, name, content"
#: Column names of the script format's tables.
STYLE_FORMAT = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FORMAT = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def _artifacts(events: DataFrame, cfg: Config) -> DataFrame:
    """video_id and made: a JSON object of the artifacts that the configuration asks for, by kind; most need a live event."""
    o, v = cfg.output, F.col("video_id").cast("string")
    image_kinds = {"ssa": (o.ssa, ".ass"), "sub": (o.vobsub, ".sub"), "idx": (o.vobsub, ".idx"), "ocr_images": (o.ocr_png, ""), "srt": (o.srt, ".srt"), "srt_subs": (o.srt and o.srt_bitmap, "_subs")}
    named = [F.when(F.lit(on) & F.col("live"), F.concat(v, F.lit(ext))).alias(kind) for kind, (on, ext) in image_kinds.items()]
    named.append(F.when(F.lit(o.json_timeline), F.concat(v, F.lit(".timeline.json"))).alias("timeline"))
    live = events.groupBy("video_id").agg(F.bool_or(~F.col("deleted")).alias("live"))
    return live.select("video_id", F.to_json(F.struct(*named)).alias("made"))


def texts(events: DataFrame, cfg: Config, width: int = 0, height: int = 0, filtered: DataFrame | None = None) -> DataFrame:
    """SRT, timeline and project documents, as the configuration asks; without live events only the last two."""
    shift = cfg.style.time_shift_10ms
    documents = artifacts.project(events, filtered, cfg.to_json(), _artifacts(events, cfg))
    made = [("esr", documents)]
    if cfg.output.json_timeline:
        made.append(("timeline.json", artifacts.timeline(events, shift, width, height)))
    if cfg.output.srt:
        made.append(("srt", artifacts.document(artifacts.srt_blocks(events, shift))))
    out = None
    for ext, rows in made:
        part = rows.select(F.col("video_id").cast("string").alias("video_id"), F.concat(F.col("video_id").cast("string"), F.lit(f".{ext}")).alias("name"), F.encode("content", "UTF-8").alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def _boxed(bits: bytes | None, w: int, h: int, box: list[int]) -> np.ndarray:
    """The mask within its box; no pixel without a mask."""
    if not bits:
        return np.zeros((0, 0), bool)
    x, y, bw, bh = box
    return Packed.unpack(bits, w, h)[y : y + bh, x : x + bw]


BOXED = ("mask", "roi_w", "roi_h", "bbox")


def polygons(events: DataFrame, cfg: Config) -> DataFrame:
    """Drawing commands of each live event, and where its box lies in the frame."""
    tolerance = 0.5 if cfg.rip.better_quality else 1.2
    columns = ["video_id", "position", "start", "end"]

    def run(batches):
        for b in batches:
            out = []
            for *boxed, origin in zip(*[b.column(c).to_pylist() for c in (*BOXED, "roi_origin")], strict=True):
                mask = _boxed(*boxed)
                out.append((origin[0] + boxed[3][0], origin[1] + boxed[3][1], render.polygon(mask, tolerance) if mask.any() else ""))
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *arrays], [*columns, "left", "top", "drawing"])

    source = artifacts.live(events).select(F.col("video_id").cast("string").alias("video_id"), F.col("position").cast("long"), "start", "end", *BOXED, "roi_origin")
    return source.mapInArrow(run, "video_id string, position long, start double, end double, left long, top long, drawing string")


def script(events: DataFrame, cfg: Config, width: int, height: int) -> DataFrame:
    """The vector script of each video: a head, then one line per live event with its drawing at its place."""
    from ..functions import text

    st = cfg.style
    name = "Extracted" if st.no_default_style else "Default"
    # The headings of the script format.
    head = (
        f"[Script Info]\nScriptType: v4.00+\nPlayResX: {width}\nPlayResY: {height}\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\nFormat: {STYLE_FORMAT}\n"
        f"Style: {name},{st.font_name},36,{st.primary_color},{st.secondary_color},{st.outline_color_ssa},{st.shadow_color},0,0,0,0,100,100,0,0,1,{st.outline_width},{st.shadow_depth},2,10,10,10,1\n\n"
        f"[Events]\nFormat: {EVENT_FORMAT}\n"
    )
    at = lambda c: text.ass_time(text.shifted(F.col(c), st.time_shift_10ms))
    place = F.format_string("{\\an7}{\\pos(%d,%d)}", "left", "top")
    drawn = F.when(F.col("drawing") == "", F.lit(" ")).otherwise(F.concat(place, F.col("drawing")))
    line = F.concat(F.lit("Dialogue: 0,"), at("start"), F.lit(", "), at("end"), F.lit(f",{name},,0,0,0,,"), drawn, F.lit("\n"))
    lines = polygons(events, cfg).select("video_id", F.col("position").alias("number"), line.alias("block"))
    done = artifacts.document(lines)
    return done.select("video_id", F.concat("video_id", F.lit(".ass")).alias("name"), F.encode(F.concat(F.lit(head), F.col("content")), "UTF-8").alias("content"))


def subpicture(mask: np.ndarray, image: np.ndarray, main: tuple, outline: tuple) -> bytes:
    """One frame of the bitmap container: sixteen palette entries, then a run-length coded span per row that has pixels."""
    return _spans(mask, _nearer(image, main, outline), main, outline)


def _nearer(image: np.ndarray, main: tuple, outline: tuple) -> np.ndarray:
    """Pixels nearer to the outline's colour than to the main one."""
    distance = lambda c: np.abs(image.astype(int) - np.array(c)).max(-1)
    return distance(outline) < distance(main)


def _spans(mask: np.ndarray, nearer: np.ndarray, main: tuple, outline: tuple) -> bytes:
    codes = np.where(render.despeckle_array(mask, 4), np.where(nearer, 2, 1), 15)
    palette = b"".join(bytes(_yuv(c)) + b"\xff" for c in ((0, 0, 0), main, outline)) + b"\0\0\0\xff" * 13
    rows = []
    for row in codes:
        on = np.flatnonzero(row != 15)
        if len(on):
            rows.append(struct.pack(">HH", on[0], on[-1]) + run_length(row[on[0] : on[-1] + 1]))
    return palette + b"".join(rows)


def _yuv(rgb: tuple) -> list[int]:
    values = np.array(YUV_WEIGHTS) @ np.array(rgb, float) + np.array([0, 128.0, 128.0])
    return [int(v) for v in np.clip(np.trunc(values), 0, 255)]


def run_length(codes: np.ndarray) -> bytes:
    """Runs as in ``artifacts.run_code``."""
    edges = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
    out = bytearray()
    for a, b in zip(edges, edges[1:], strict=False):
        n, c = int(b - a), int(codes[a])
        out += bytes([n << 4 | c]) if n <= 15 else bytes([c, n]) if n <= 255 else bytes([c, 0, n >> 8, n & 255])
    return bytes(out)


def previews(frames: DataFrame, cfg: Config) -> DataFrame:
    """What each frame's mask would be exported as: video_id, idx, width, height, content (PNG); nulls for an empty mask.

    frames: video_id, idx, mask (``masks.Packed``), roi_w, roi_h, and roi (RGB of the region) or not.
    """
    pictured = [c for c in ("roi",) if c in frames.columns]

    def run(batches):
        for b in batches:
            out = []
            for bits, w, h, *roi in zip(*[b.column(c).to_pylist() for c in ("mask", "roi_w", "roi_h", *pictured)], strict=True):
                if not bits:
                    out.append((None, None, None))
                    continue
                x, y, bw, bh = box = Packed.box(Packed.unpack(bits, w, h))
                own = np.frombuffer(roi[0], np.uint8).reshape(h, w, 3)[y : y + bh, x : x + bw].tobytes() if roi and roi[0] else None
                image = render.finished(render.picture(_boxed(bits, w, h, box), own, cfg.output.ocr), cfg.output.ocr)
                out.append((image.shape[1], image.shape[0], render.png(np.ascontiguousarray(image))))
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("idx"), *arrays], ["video_id", "idx", "width", "height", "content"])

    source = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("idx").cast("long"), "mask", F.col("roi_w").cast("int"), F.col("roi_h").cast("int"), *pictured)
    return source.mapInArrow(run, "video_id string, idx long, width int, height int, content binary")


def encoder(ocr):
    """The function that encodes a picture in the configured format, and the extension of its files."""
    kind = ocr.format.lower().strip().lstrip(".")
    if kind in ("jpg", "jpeg"):
        return (lambda image: jpeg(image, max(1, min(ocr.quality, 100)))), "jpg"
    return (render.bmp, "bmp") if kind == "bmp" else (render.png, "png")


def tiles(events: DataFrame, cfg: Config) -> DataFrame:
    """Pictures of live events, per_image positions on a canvas: rows of (video_id, name, content).

    Batches count positions before empty masks are left out; a batch without a tile has no picture and no number.  Canvases of
    two lines are cut in two where that is asked for and a blank band is found.
    """
    ocr = cfg.output.ocr
    encode, ext = encoder(ocr)
    bg = render.colour_of(ocr.bg_color, (255, 255, 255))

    coloured = render.in_colour(ocr)

    def files(*items):
        """(tag, content) of the pictures of one canvas."""
        image = render.finished(render.side_by_side([render.picture(_boxed(*boxed), own, ocr) for *boxed, own in items], bg=bg), ocr)
        cut = render.blank_split(image, bg) if ocr.divid_into_2_lines and len(image) >= 12 else None
        parts = [("", image)] if cut is None else list(zip(("_top", "_bottom"), render.halves(image, cut), strict=True))
        return [(tag, encode(np.ascontiguousarray(part))) for tag, part in parts]

    def run(batches):
        canvas = render.remembered(files)
        for b in batches:
            out = []
            for v, number, items in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = [(i["mask"], i["roi_w"], i["roi_h"], tuple(i["bbox"]), i["image"] if coloured else None) for i in items]
                size = sum(w * h + len(image or b"") for _, w, h, _, image in own)
                out += [(v, f"{v}/subtitle_{number:04d}{tag}.{ext}", content) for tag, content in canvas(size, *own)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["video_id", "name", "content"])

    live = artifacts.live(events).withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy("position")) - 1)
    batch = F.floor(F.col("place") / max(ocr.per_image, 1))
    item = F.struct("place", *BOXED, "image")
    grouped = live.filter("mask is not null").groupBy(F.col("video_id").cast("string").alias("video_id"), batch.alias("batch")).agg(F.array_sort(F.collect_list(item), lambda a, b: a["place"] - b["place"]).alias("items"))
    number = F.row_number().over(W.partitionBy("video_id").orderBy("batch"))
    return grouped.select("video_id", number.alias("number"), "items").mapInArrow(run, "video_id string, name string, content binary")


def bitmap_subtitles(events: DataFrame, cfg: Config) -> DataFrame:
    """Intervals plus one BMP per live event, named by its number."""
    own = replace(cfg, output=replace(cfg.output, ocr=replace(cfg.output.ocr, format="bmp", per_image=1, divid_into_2_lines=False)))
    named = F.format_string("%s_subs/%05d.bmp", F.col("video_id"), F.regexp_extract("name", r"subtitle_(\d+)", 1).cast("int"))
    return tiles(events, own).withColumn("name", named)


def subpictures(events: DataFrame, cfg: Config, width: int, height: int) -> DataFrame:
    """The bitmap container of each video and its index, from live events with a mask and their images.

    The frames of a video are joined once, in order, by one Arrow pass; a container is one file, so it is one row.
    """
    from ..functions import text

    main, outline = cfg.filter.subtitle_color, cfg.filter.outline_color
    columns = ["video_id", "position", "start"]

    def spans(bits, w, h, box, nearer):
        mask = _boxed(bits, w, h, box)
        return _spans(mask, np.frombuffer(nearer, bool).reshape(mask.shape), main, outline)

    def run(batches):
        frame = render.remembered(spans)
        for b in batches:
            out = []
            for bits, w, h, box, image in zip(*[b.column(c).to_pylist() for c in (*BOXED, "image")], strict=True):
                nearer = _nearer(np.frombuffer(image, np.uint8).reshape(-1, 3), main, outline).tobytes()
                body = frame(w * h, bits, w, h, tuple(box), nearer)
                out.append(b"\0\0\0\0" + struct.pack(">I", len(body)) + body)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(out, pa.binary())], [*columns, "frame"])

    def join(batches):
        video, parts = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([video]), pa.array([b"".join(parts)], pa.binary())], ["video_id", "content"])

        for b in batches:
            for v, frame in zip(b.column("video_id").to_pylist(), b.column("frame").to_pylist(), strict=True):
                if v != video and parts:
                    yield done()
                    parts = []
                video = v
                parts.append(frame)
        if parts:
            yield done()

    source = artifacts.live(events).filter("mask is not null").select(F.col("video_id").cast("string").alias("video_id"), F.col("position").cast("long"), "start", *BOXED, "image")
    frames = stored(source.mapInArrow(run, "video_id string, position long, start double, frame binary"), "subpictures")
    body = frames.repartition("video_id").sortWithinPartitions("video_id", "position").select("video_id", "frame").mapInArrow(join, "video_id string, content binary")
    placed = artifacts.offsets(frames.select(*columns, F.octet_length("frame").alias("size")), F.col("size") - 8)
    ordered = placed.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("position", "start", "offset"))).alias("s"))
    colours = ", ".join("%02x%02x%02x" % tuple(_yuv(c)) for c in (outline, main, (255, 255, 255), (0, 0, 0))) + ", 000000" * 12
    # The headings of the container's index.
    head = (
        f"# VobSub index file, v7 (do not modify this line!)\nsize: {width}x{height}\norg: 0, 0\nscale: 100%, 100%\nsmooth: OFF\nfade: 0, 0\nalign: 0, 0\ntime offset: 0\nforced subs: OFF\n"
        "# Custom colors (transp idxs and the four colors)\ncustom colors: OFF, tridx: 1110, colors: 0, 0, ffffff, 000000\n"
        f"# The original palette of the DVD in PGC#1\npalette: {colours}\nlangidx: 0\n"
        "# Decomment next line to activate alternative name in DirectVobSub / Windows Media Player 6.x\n# Force subtitle placement relative to (org.x, org.y)\nid: en, index: 0\n"
    )
    at = lambda x: text.vobsub_time(text.shifted(x["start"], cfg.style.time_shift_10ms))
    line = lambda x: F.concat(F.lit("timestamp: "), at(x), F.lit(", filepos: "), F.lpad(F.lower(F.hex(x["offset"])), 9, "0"), F.lit("\n"))
    index = F.encode(F.concat(F.lit(head), F.array_join(F.transform("s", line), "")), "UTF-8")
    named = lambda rows, ext: rows.select("video_id", F.concat("video_id", F.lit(ext)).alias("name"), "content")
    return named(ordered.select("video_id", index.alias("content")), ".idx").unionByName(named(body, ".sub"))


def everything(events: DataFrame, cfg: Config, width: int, height: int, filtered: DataFrame | None = None) -> DataFrame:
    """All artifacts the configuration asks for, as rows of (video_id, name, content).

    events and filtered are a rip's (``operators.rip``), numbered by position and with deleted.  Videos without a live
    event have only their timeline and project; the project keeps deleted and filtered events and names the artifacts.
    """
    missing = [c for c in ("mask", "image", "roi_w", "roi_h", "bbox", "roi_origin", "source_frame") if c not in events.columns]
    if missing:
        raise ValueError(f"events lack {', '.join(missing)}")
    out = texts(events, cfg, width, height, filtered)
    if cfg.output.ssa:
        out = out.unionByName(script(events, cfg, width, height))
    if cfg.output.vobsub:
        out = out.unionByName(subpictures(events, cfg, width, height))
    if cfg.output.ocr_png:
        out = out.unionByName(tiles(events, cfg))
    if cfg.output.srt and cfg.output.srt_bitmap:
        out = out.unionByName(bitmap_subtitles(events, cfg))
    return out
