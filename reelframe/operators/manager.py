"""Edits of an event table.

Rows carry `position` (0-based, as requests name them); results are renumbered by start, equal starts keeping their order.
Every edit is a pure function: the table of the next version.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import render
from .masks import Bits, Packed
from .segment import merge_repeats as _merge_repeats

KEY = "video_id"


def numbered(events: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """position by start; NULL and NaN starts last; ties by the old position."""
    by = order or ["start", "position"]
    return events.withColumn("position", F.row_number().over(W.partitionBy(KEY).orderBy(*by)) - 1)


def listing(events: DataFrame) -> DataFrame:
    """What a manager shows: 1-based index and times to two places."""
    two = lambda c: (F.round(F.col(c) * 100) / 100).alias(c)
    return events.select(KEY, (F.col("position") + 1).alias("index"), two("start"), two("end"), "start_frame", "end_frame", "deleted")


def gallery(events: DataFrame, filtered: DataFrame, ocr) -> DataFrame:
    """The listing with pictures, of a rip's events and of its filtered ones: part, the listing's columns, n, bbox, image and
    its size, and render, the tile that would be exported, as RGB with its size (empty without a mask)."""
    columns = [KEY, "position", "start", "end", "start_frame", "end_frame", "n", "deleted", "mask", "roi_w", "roi_h", "bbox", "image"]
    both = events.select(*columns, F.lit("subtitles").alias("part")).unionByName(filtered.select(*columns, F.lit("filtered").alias("part")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)

    coloured = render.in_colour(ocr)

    def made_of(bits, w, h, box, image):
        x, y, bw, bh = box
        tile = render.bare(Packed.unpack(bits, w, h)[y : y + bh, x : x + bw], image, ocr)
        return np.ascontiguousarray(tile).tobytes(), tile.shape[1], tile.shape[0]

    def run(batches):
        tile = render.remembered(made_of)
        for b in batches:
            made = []
            for bits, w, h, box, image in zip(*[b.column(c).to_pylist() for c in ("mask", "roi_w", "roi_h", "bbox", "image")], strict=True):
                image = image if coloured else None
                made.append(tile(w * h + len(image or b""), bits, w, h, tuple(box), image) if bits else (b"", 0, 0))
            arrays = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, "render", "render_w", "render_h"])

    rows = both.mapInArrow(run, f"{kinds}, render binary, render_w int, render_h int")
    two = lambda c: (F.round(F.col(c) * 100) / 100).alias(c)
    return rows.select(
        KEY, "part", (F.col("position") + 1).alias("index"), two("start"), two("end"), "start_frame", "end_frame", "n", "deleted", "bbox",
        F.col("bbox")[2].alias("image_w"), F.col("bbox")[3].alias("image_h"), "image", "render", "render_w", "render_h",
    )


def _appended(events: DataFrame, added: DataFrame) -> DataFrame:
    """Both, renumbered by start; of equal starts the added rows come last."""
    both = events.withColumn("late", F.lit(0)).unionByName(added.withColumn("late", F.lit(1)))
    return numbered(both, ["start", "late", "position"]).drop("late")


def recover(events: DataFrame, filtered: DataFrame) -> DataFrame:
    """Filtered rows return as live ones; rows deleted before stay deleted."""
    return _appended(events, filtered.withColumn("deleted", F.lit(False)))


def remove(events: DataFrame, positions: list[int]) -> DataFrame:
    """Marks rows deleted; positions that do not exist are ignored."""
    return events.withColumn("deleted", F.col("deleted") | F.col("position").isin(*positions)) if positions else events


def purge(events: DataFrame) -> DataFrame:
    return numbered(events.filter(~F.col("deleted")), ["position"])


def _frames(events: DataFrame, hit: Column, fps: float, n: str = "n") -> DataFrame:
    """Frames of edited rows follow their times; their count is the number of frames they span."""
    first, last = F.round(F.col("start") * fps).cast("long"), F.round(F.col("end") * fps).cast("long")
    return events.withColumns({
        "start_frame": F.when(hit, first).otherwise(F.col("start_frame")),
        "end_frame": F.when(hit, last).otherwise(F.col("end_frame")),
        n: F.when(hit, F.greatest(last - first, F.lit(1))).otherwise(F.col(n)),
    })


def edit(events: DataFrame, edits: DataFrame, fps: float) -> DataFrame:
    """edits: video_id, position, new_start, new_end (null keeps a time)."""
    both = events.join(edits.withColumn("edited", F.lit(True)), [KEY, "position"], "left")
    hit = F.coalesce(F.col("edited"), F.lit(False))
    both = both.withColumns({"start": F.coalesce("new_start", "start"), "end": F.coalesce("new_end", "end")})
    return _frames(both, hit, fps).select(*events.columns)


def shift(events: DataFrame, offset_ms: int, fps: float, positions: list[int] | None = None) -> DataFrame:
    """Moves the rows at positions, or all live ones, by an offset that is not zero; times stop at 0."""
    if not offset_ms:
        raise ValueError("offset_ms must not be 0")
    hit = F.col("position").isin(*positions) if positions else ~F.col("deleted")
    move = lambda c: F.when(hit, F.greatest(F.col(c) + F.lit(offset_ms / 1000.0), F.lit(0.0))).otherwise(F.col(c))
    return _frames(events.withColumns({"start": move("start"), "end": move("end")}), hit, fps)


def split(events: DataFrame, at: DataFrame, fps: float, frame_masks: DataFrame, masks=Bits) -> DataFrame:
    """at: video_id, position, t with start < t < end; the row becomes two that meet at t, each captured anew from its frames.

    A request out of range, or with a half that has no frame with a mask, changes nothing.
    """
    both = events.join(at.select(KEY, "position", "t"), [KEY, "position"], "left")
    good = F.coalesce((F.col("t") > F.col("start")) & (F.col("t") < F.col("end")), F.lit(False))
    half = lambda k, a, b: F.struct(F.lit(k).alias("half"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    parts = F.array(half(0, F.col("start"), F.col("t")), half(1, F.col("t"), F.col("end")))
    halves = both.filter(good).withColumn("part", F.explode(parts)).withColumns({"start": F.col("part.a"), "end": F.col("part.b"), "whole": F.col("position")})
    halves = _frames(halves.withColumn("position", F.col("position") * 2 + F.col("part.half")), F.lit(True), fps)
    halves = _captured(halves.select(*events.columns, "whole"), frame_masks, fps, masks, near=True)
    row = lambda late: F.struct(*events.columns, late.cast("int").alias("late"))
    done = halves.groupBy(KEY, F.col("whole").alias("position")).agg(F.collect_list(row(F.pmod("position", F.lit(2)))).alias("halves"), F.bool_and("captured").alias("ok"))
    done = done.filter("ok").drop("ok")
    # Each row gives itself or its halves, so that captures are made once.
    parts = events.join(done, [KEY, "position"], "left").select(KEY, F.col("position").alias("whole"), F.explode(F.coalesce("halves", F.array(row(F.lit(0))))).alias("row"))
    kept = [F.col(c) if c == KEY else F.col("whole").alias(c) if c == "position" else F.col(f"row.{c}").alias(c) for c in [*events.columns, "late"]]
    return numbered(parts.select(*kept), ["start", "late", "position"]).drop("late")


def merge(events: DataFrame, positions: tuple[int, int], fps: float, frame_masks: DataFrame, masks=Bits) -> DataFrame:
    """Exactly two rows of each video become one from the smaller start to the larger end, captured anew from its frames.

    What the rows do not share comes from the one named first.  A video without both rows, or without a frame with a mask
    in the span, does not change.
    """
    first, second = positions
    if first == second:
        raise ValueError("two different rows are needed")
    pair = events.filter(F.col("position").isin(first, second))
    how = {"start": F.min("start"), "end": F.max("end"), "position": F.max("position")}
    rank = (F.col("position") != first).cast("int")
    agg = [how.get(c, F.min_by(c, rank)).alias(c) for c in events.columns if c != KEY]
    one = pair.groupBy(KEY).agg(*agg, F.count("*").alias("rows")).filter(F.col("rows") == 2).drop("rows")
    one = _captured(_frames(one, F.lit(True), fps).select(*events.columns), frame_masks, fps, masks, near=True).filter("captured")
    # The merged row stands in the place of the later one; the earlier one meets an empty row, so that captures are made once.
    row = F.struct(*[c for c in events.columns if c != KEY])
    places = F.array(*[F.struct(F.lit(p).cast("long").alias("at"), F.when(F.col("position") == p, row).alias("row")) for p in (first, second)])
    done = one.select(KEY, F.explode(places).alias("place")).select(KEY, F.col("place.at").alias("position"), F.col("place.row").alias("row"), F.lit(True).alias("met"))
    both = events.join(done, [KEY, "position"], "left").filter("met is null or row is not null")
    kept = [F.col(c) if c in (KEY, "position") else F.when(F.col("met"), F.col(f"row.{c}")).otherwise(F.col(c)).alias(c) for c in events.columns]
    both = both.select(*kept, F.coalesce(F.col("met"), F.lit(False)).cast("int").alias("late"))
    return numbered(both, ["start", "late", "position"]).drop("late")


def merge_repeat(events: DataFrame, max_gap: float = 0.2, merged_from: float = 0.9, masks=Bits) -> DataFrame:
    """Merges repeats among live rows in their order by start; deleted rows stay as they are."""
    live = numbered(events.filter(~F.col("deleted"))).withColumnRenamed("position", "event_no")
    done = _merge_repeats(live, max_gap, merged_from, masks=masks).withColumnRenamed("event_no", "position")
    return _appended(done.select(*events.columns), events.filter("deleted"))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many live rows of each video an edit such as merge_repeat has taken away."""
    count = lambda df, name: df.filter(~F.col("deleted")).groupBy(KEY).agg(F.count("*").alias(name))
    both = count(before, "n0").join(count(after, "n1"), KEY, "left").na.fill(0)
    return both.select(KEY, (F.col("n0") - F.col("n1")).alias("removed"))


def recapture(events: DataFrame, frame_masks: DataFrame, fps: float, masks=Bits) -> DataFrame:
    """Events with mask, last frame and end taken anew from the non-empty masks of the frames they span.

    frame_masks: video_id, idx, time, mask.  Start and its frame stay; events without a non-empty frame keep all.
    """
    return _captured(events, frame_masks, fps, masks).drop("captured")


def _captured(events: DataFrame, frame_masks: DataFrame, fps: float, masks, near: bool = False) -> DataFrame:
    """recapture() with whether there was a frame.

    near: the events are few of each video and lie near each other.  Frames before the first and after the last of them are
    then left out before frames are exchanged; frames that lie together by video are not moved for that.
    """
    spans = events.select(KEY, "position", "start_frame", "end_frame")
    full = frame_masks.filter(~masks.is_empty(F.col("mask")))
    if near:
        ranges = spans.groupBy(KEY).agg(F.min("start_frame").alias("from"), F.max("end_frame").alias("to"))
        full = full.join(ranges, KEY).filter((F.col("idx") >= F.col("from")) & (F.col("idx") <= F.col("to"))).drop("from", "to")
    # The range join meets frames by blocks of 256, so that it is an equi-join.
    block = lambda c: F.floor(F.col(c) / 256)
    spans = spans.withColumn("block", F.explode(F.sequence(block("start_frame"), block("end_frame"))))
    inside = spans.join(full.withColumn("block", block("idx")), [KEY, "block"]).filter((F.col("idx") >= F.col("start_frame")) & (F.col("idx") <= F.col("end_frame")))
    taken = inside.groupBy(KEY, "position").agg(masks.union_all("mask").alias("mask2"), F.max("idx").alias("idx2"), F.max("time").alias("time2"), F.count("*").alias("n2"))
    both = events.join(taken, [KEY, "position"], "left")
    return both.withColumns({
        "mask": F.coalesce("mask2", "mask"),
        "end": F.coalesce(F.col("time2") + 1.0 / fps, F.col("end")),
        "end_frame": F.coalesce("idx2", "end_frame"),
        "n": F.coalesce("n2", "n"),
        "captured": F.col("n2").isNotNull(),
    }).select(*events.columns, "captured")
