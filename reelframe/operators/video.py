"""Video metadata: defaults, frame clocks and ranges, batches and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FALLBACK_FPS = 25.0


def with_defaults(videos: DataFrame) -> DataFrame:
    """rate, container_s, stream_s, frames -> fps, duration_s, frame_count.

    A rate outside 1..1000 is 25; a duration is the container's if it is between 0 and 100 000 s, else the stream's, else 0;
    a missing frame count is the rounded product.
    """
    fps = F.when(F.col("rate").between(1, 1000), F.col("rate")).otherwise(F.lit(FALLBACK_FPS))
    inside = (F.col("container_s") > 0) & (F.col("container_s") < 1e5)
    duration = F.when(inside, F.col("container_s")).otherwise(F.coalesce("stream_s", F.lit(0.0)))
    rows = videos.withColumns({"fps": fps, "duration_s": duration})
    computed = F.greatest(F.round(F.col("duration_s") * F.col("fps")).cast("long"), F.lit(0))
    return rows.withColumn("frame_count", F.when(F.col("frames") > 0, F.col("frames")).otherwise(computed))


def frame_clock(pts: Column, time_base: Column, fps: Column, counter: Column, fallback_fps: float = FALLBACK_FPS) -> tuple[Column, Column]:
    """Frame index and time of a time stamp; without one they come from a counter."""
    idx = F.coalesce(F.round(pts * time_base * fps).cast("long"), counter)
    return idx, F.coalesce(pts * time_base, counter / F.lit(fallback_fps))


def frame_range(start_s: Column, end_s: Column, fps: Column, total: Column) -> tuple[Column, Column]:
    """[first, last) frames of a range in seconds; an end of 0 is the video's; at least one frame, within the video."""
    first = F.round(start_s * fps).cast("long")
    end = F.when(end_s > 0, F.round(end_s * fps).cast("long")).otherwise(total)
    return first, F.least(F.greatest(end, first + 1), F.greatest(total, F.lit(1)))


def batch_state(items: DataFrame, state: str, pending: str, ended: list[str]) -> DataFrame:
    """Per batch the first pending item and whether all items have ended."""
    return items.groupBy("batch").agg(F.min(F.when(F.col(state) == pending, F.col("item"))).alias("next_item"), (F.count_if(F.col(state).isin(*ended)) == F.count("*")).alias("done"))


def progress(frames: DataFrame, by: str, order: str, fps: float) -> DataFrame:
    """A row after every whole second's worth of frames: frames done and percent."""
    per = W.partitionBy(by)
    rows = frames.select(by, F.row_number().over(per.orderBy(order)).alias("frames_done"), F.count("*").over(per).alias("n"))
    rows = rows.filter(F.col("frames_done") % int(max(fps, 1.0)) == 0)
    return rows.select(by, "frames_done", F.floor(F.col("frames_done") * 100 / F.col("n")).alias("percent"))
