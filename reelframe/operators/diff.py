"""Comparison of each sampled frame with the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour
from .pixel import KEYS


def sample(frames: DataFrame, start: int = 0, end: int | None = None, step: int = 1, frame_count: int = 0) -> DataFrame:
    """Frames of [start, end) in strides of step from start; none if the range is empty or step is below 1.

    A negative start is 0; end stops at frame_count where that is known (above 0), and is open if it is None.
    """
    start = max(start, 0)
    if frame_count > 0:
        end = frame_count if end is None else min(end, frame_count)
    if end is not None and end <= start or step < 1:
        return frames.limit(0)
    inside = (F.col("idx") >= start) & ((F.col("idx") - start) % step == 0)
    return frames.filter(inside if end is None else inside & (F.col("idx") < end))


def previous_index(frames: DataFrame, one_row_each: bool = False) -> DataFrame:
    """(video_id, idx, prev_idx) of the frames that have one before them: rows are frames, so the window is narrow."""
    ids = frames.select("video_id", "idx")
    ids = ids if one_row_each else ids.distinct()
    return ids.withColumn("prev_idx", F.lag("idx").over(W.partitionBy("video_id").orderBy("idx"))).filter("prev_idx is not null")


def pixel_changes(pixels: DataFrame, threshold: int = 24) -> DataFrame:
    """Each pixel of each frame that has one before it, with whether any channel differs by more than threshold.

    Pixels meet those of the frame before by an equi-join on (video, frame, place): partitions follow frames, so no task
    holds all frames of a pixel, as a window over them would.
    """
    pairs = previous_index(pixels)
    now = pixels.join(pairs, KEYS)
    then = pixels.select("video_id", F.col("idx").alias("prev_idx"), "pos", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    both = now.join(then, ["video_id", "prev_idx", "pos"])
    moved = colour.chebyshev(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"p{c}") for c in "rgb")) > threshold
    return both.select(*KEYS, "prev_idx", "pos", "r", "g", "b", moved.alias("changed"))


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changed pixels, of pixels, and their ratio by frame."""
    counted = changes.groupBy(*KEYS).agg(F.count_if("changed").alias("changed"), F.count("*").alias("n"))
    return counted.withColumn("ratio", F.when(F.col("n") > 0, F.col("changed") / F.col("n")).otherwise(F.lit(0.0)))


def is_change(changed: Column, ratio: Column, pixels: int = 20, percent: float = 0.5) -> Column:
    return (changed >= pixels) & (ratio * 100.0 >= percent)


def change_frames(changes: DataFrame, pixels: int = 20, percent: float = 0.5) -> DataFrame:
    return change_counts(changes).filter(is_change(F.col("changed"), F.col("ratio"), pixels, percent))
