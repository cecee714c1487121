"""Rows of the artifacts that are written per video, as DataFrames; ``sources.writers`` stores them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from .masks import Packed


def live(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("deleted"))


def srt_blocks(events: DataFrame, shift_10ms: int = 0, by: str = "video_id") -> DataFrame:
    """One numbered block per live event: number, interval, an empty text line."""
    number = F.row_number().over(W.partitionBy(by).orderBy("position"))
    at = lambda c: text.srt_time(text.shifted(F.col(c), shift_10ms))
    block = F.concat(number.cast("string"), F.lit("\n"), at("start"), F.lit(" --> "), at("end"), F.lit("\n\n\n"))
    return live(events).select(by, number.alias("number"), block.alias("block"))


def document(blocks: DataFrame, by: str = "video_id") -> DataFrame:
    """All blocks of a video in order as one string; a video's artifact is one file, so it must fit in one row anyway."""
    joined = F.array_sort(F.collect_list(F.struct("number", "block")))
    return blocks.groupBy(by).agg(F.array_join(F.transform(joined, lambda x: x["block"]), "").alias("content"))


def timeline(events: DataFrame, shift_10ms: int = 0, width: int = 0, height: int = 0, by: str = "video_id") -> DataFrame:
    """One JSON document per video: its size, the time shift, the count and the live events with shifted times to four
    places, their boxes and the origin of their region; none live: an empty list.  Missing boxes are zeros."""
    alive = (~F.col("deleted")).cast("int")
    number = F.sum(alive).over(W.partitionBy(by).orderBy("position"))
    at = lambda c: text.rounded(text.shifted(F.col(c), shift_10ms), 4).alias(c)
    item = F.struct(number.cast("int").alias("index"), at("start"), at("end"), "start_frame", "end_frame", _numbers(events, "bbox", 4), _numbers(events, "roi_origin", 2), F.col("n").alias("diff_frames"))
    rows = events.select(by, F.when(~F.col("deleted"), item).alias("item"))
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list("item")).alias("subtitles"))
    video = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height")).alias("video")
    style = F.struct(F.lit(shift_10ms).alias("time_shift_10ms")).alias("style")
    return listed.select(by, F.to_json(F.struct(video, style, F.size("subtitles").alias("count"), "subtitles")).alias("content"))


def _numbers(events: DataFrame, name: str, n: int) -> Column:
    zeros = F.array(*[F.lit(0).cast("bigint")] * n)
    return (F.coalesce(F.col(name).cast("array<bigint>"), zeros) if name in events.columns else zeros).alias(name)


def byte_masks(events: DataFrame) -> DataFrame:
    """events (mask as ``masks.Packed``, roi_w, roi_h, bbox) with mask_bytes, the box's mask, and roi_mask_bytes, the
    region's: a byte of 0 or 255 a pixel, empty where there is no mask."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(batches):
        for b in batches:
            box, whole = [], []
            for bits, w, h, at in zip(*[b.column(c).to_pylist() for c in ("mask", "roi_w", "roi_h", "bbox")], strict=True):
                mask = Packed.unpack(bits, w, h).view(np.uint8) * 255 if bits else np.zeros((0, 0), np.uint8)
                x, y, bw, bh = at or (0, 0, 0, 0)
                box.append(mask[y : y + bh, x : x + bw].tobytes()), whole.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(box, pa.binary()), pa.array(whole, pa.binary())], [*b.schema.names, "mask_bytes", "roi_mask_bytes"])

    return events.mapInArrow(run, f"{kinds}, mask_bytes binary, roi_mask_bytes binary")


def project(events: DataFrame, filtered: DataFrame | None = None, config: str = "{}", artifacts: DataFrame | None = None, by: str = "video_id") -> DataFrame:
    """One project document per video with all rows, deleted ones too, and its filtered events.

    events and filtered: position, start, end, start_frame, end_frame, n, deleted, mask (``masks.Packed``), image (RGB of
    the box), roi_w, roi_h, bbox, roi_origin and source_frame.  config is a JSON text; artifacts has by and made, a JSON object of names by kind.
    """

    def items(rows: DataFrame, part: str) -> DataFrame:
        rows = byte_masks(rows)
        code = lambda c, name: text.base64_text(F.coalesce(F.col(c), F.lit(b""))).alias(name)
        of_box = lambda k: F.coalesce(F.col("bbox")[k], F.lit(0)).cast("long")
        item = F.struct(
            (F.col("position") + 1).alias("index"), "start", "end", "start_frame", "end_frame", _numbers(rows, "bbox", 4), _numbers(rows, "roi_origin", 2), "roi_w", "roi_h",
            of_box(2).alias("image_w"), of_box(3).alias("image_h"), F.col("n").alias("diff_frames"), "source_frame", "deleted",
            code("image", "image_b64"), code("mask_bytes", "mask_b64"), code("roi_mask_bytes", "roi_mask_b64"),
        )
        return rows.select(by, F.lit(part).alias("part"), F.struct("position", F.to_json(item).alias("json")).alias("item"))

    rows = items(events, "subtitles")
    if filtered is not None:
        rows = rows.unionByName(items(filtered, "filtered"))
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("item")))).alias(part)
    listed = rows.groupBy(by).agg(of("subtitles"), of("filtered"))
    joined = lambda part: F.array_join(F.transform(part, lambda x: x["json"]), ",")
    quoted = F.to_json(F.array(F.col(by).cast("string")))  # the name between brackets
    listed = listed.withColumn("made", F.lit("{}")) if artifacts is None else listed.join(artifacts.select(by, "made"), by, "left")
    head = F.concat(F.lit('{"format":"reelframe-project","version":2,"video":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(f',"config":{config},"artifacts":'), F.coalesce("made", F.lit("{}")))
    return listed.select(by, F.concat(head, F.lit(',"filtered":['), joined("filtered"), F.lit('],"subtitles":['), joined("subtitles"), F.lit("]}")).alias("content"))


def runs(values: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Maximal runs of equal neighbouring values: by, run, value, first place, length."""
    order = W.partitionBy(*by).orderBy(at)
    new = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    numbered = values.withColumn("starts_run", new).withColumn("run", F.sum("starts_run").over(order))
    return numbered.groupBy(*by, "run").agg(F.any_value(value).alias(value), F.min(at).alias("first"), F.count("*").alias("length"))


def run_code(colour: Column, length: Column) -> Column:
    """Hex of a run: length and colour in one byte up to 15; colour and length up to 255; else colour, 0 and two bytes."""
    two = lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), 2, "0")
    return (
        F.when(length <= 15, two(length * 16 + colour))
        .when(length <= 255, F.concat(two(colour), two(length)))
        .otherwise(F.concat(two(colour), F.lit("00"), F.lpad(F.lower(F.hex(length.cast("long"))), 4, "0")))
    )


def offsets(frames: DataFrame, size: Column, by: str = "video_id") -> DataFrame:
    """Byte offset of each frame of a container whose frames have an 8-byte head."""
    before = W.partitionBy(by).orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    return frames.withColumn("offset", F.coalesce(F.sum(size + 8).over(before), F.lit(0)))


def batches(events: DataFrame, per_image: int, by: str = "video_id", gap: int = 4) -> DataFrame:
    """Image number and canvas size of tiles put side by side; batches count positions, empty masks leave no tile.

    Batches whose tiles are all empty get no number.
    """
    batch = F.floor(F.col("position") / max(per_image, 1))
    tiles = events.filter("mask <> 0").groupBy(by, batch.alias("batch")).agg(F.count("*").alias("tiles"), (F.lit(gap) + F.sum(F.col("width") + gap)).alias("canvas_w"), F.max("height").alias("canvas_h"))
    return tiles.withColumn("image", F.row_number().over(W.partitionBy(by).orderBy("batch")))


def blank_split(rows: DataFrame, by: str = "image") -> DataFrame:
    """rows: image, y, blank, h -> the middle of the longest run of blank rows where it lies strictly in the middle half."""
    found = runs(rows, [by], "y", "blank").filter("blank")
    best = found.groupBy(by).agg(F.sum("length").alias("blank_rows"), F.max_by(F.struct("first", "length"), F.struct("length", -F.col("first"))).alias("best"))
    heights = rows.groupBy(by).agg(F.max("h").alias("h"))
    middle = F.floor((F.col("best.first") * 2 + F.col("best.length") - 1) / 2)
    out = best.join(heights, by).withColumn("split_y", middle)
    return out.filter((F.col("blank_rows") >= 3) & (F.col("split_y") > F.floor(F.col("h") / 4)) & (F.col("split_y") < F.floor(F.col("h") * 3 / 4))).select(by, "split_y")


def tail(lines: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The last n lines of each log, in order."""
    back = W.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return lines.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)


def ring(lines: DataFrame, size: int, by: str, order: list[str]) -> DataFrame:
    """What a ring of so many lines holds at the end of each log: the number held and of older lines dropped."""
    held = tail(lines, size, by, order).groupBy(by).agg(F.count("*").alias("held"))
    return lines.groupBy(by).agg(F.count("*").alias("n")).join(held, by).select(by, (F.col("n") - F.col("held")).alias("dropped"), "held")


def settings(documents: DataFrame, by: str, fps: float = 25.0, frames: int = 0) -> DataFrame:
    """Scaling, gap, kinds of written artifacts and frame range of configuration documents (by, config)."""
    source = documents.select(by, "config")
    kind = source.schema[by].dataType.simpleString()

    def read(document: str) -> tuple:
        c = Config.from_json(document)
        return c.roi_scale(), c.rip.gap_frames, ",".join(c.output.kinds()), *c.frame_range(fps, frames)

    def run(batches):
        kept = lru_cache(4096)(read)  # a task's documents repeat
        for b in batches:
            found = [kept(t or "{}") for t in b.column("config").to_pylist()]
            arrays = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(by), *arrays], [by, "roi_scale", "gap_frames", "kinds", "first_frame", "end_frame"])

    return source.mapInArrow(run, f"{by} {kind}, roi_scale double, gap_frames bigint, kinds string, first_frame bigint, end_frame bigint")
