"""Candidates from change frames, and one-shot colour tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .masks import Bits
from .pixel import KEYS

CHANGED_BELOW = 0.7


def candidates(rows: DataFrame, masks=Bits, below: float = CHANGED_BELOW) -> DataFrame:
    """Change frames (video_id, idx, mask, change_mask) -> kind: candidate, close or filtered; other frames give no row.

    What the frame before left behind is exactly its own mask (an empty one counts as none), so one lag over change
    frames replaces a state machine.
    """
    before = F.lag("mask").over(W.partitionBy("video_id").orderBy("idx"))
    seen = rows.withColumn("before", F.coalesce(before, masks.empty()))
    none_now, none_before = masks.is_empty(F.col("mask")), masks.is_empty(F.col("before"))
    kind = (
        F.when(~none_now & (none_before | (masks.iou(F.col("before"), F.col("mask")) < below)), F.lit("candidate"))
        .when(none_now & ~none_before, F.lit("close"))
        .when(none_now & ~masks.is_empty(F.col("change_mask")), F.lit("filtered"))
    )
    found = seen.withColumn("kind", kind).filter("kind is not null")
    return found.withColumn("mask", F.when(F.col("kind") == "filtered", F.col("change_mask")).otherwise(F.col("mask"))).drop("before")


def auto_colours(changed: DataFrame) -> DataFrame:
    """Main and outline colour of each frame's changed pixels (video_id, idx, pos, r, g, b).

    Pixels are ordered by r + g + b, ties by place.  The brightest 15 % give the main colour and the darkest 15 % (at least
    one) the outline colour, channel by channel as upper medians.  Frames with fewer than 16 changed pixels get white and
    black.
    """
    frame = W.partitionBy(*KEYS)
    lum = F.col("r") + F.col("g") + F.col("b")
    ranked = changed.withColumns({"rank": F.row_number().over(frame.orderBy(lum, "pos")) - 1, "n": F.count("*").over(frame)})
    cut = lambda share: F.floor(F.col("n") * share / 100)
    is_high, is_low = F.col("rank") >= cut(85), F.col("rank") < F.greatest(cut(15), F.lit(1))

    def median(c: str, where) -> F.Column:
        values = F.array_sort(F.collect_list(F.when(where, F.col(c))))
        return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))

    found = ranked.groupBy(*KEYS).agg(F.count("*").alias("n"), *[median(c, is_high).alias(f"main_{c}") for c in "rgb"], *[median(c, is_low).alias(f"outline_{c}") for c in "rgb"])
    few = F.col("n") < 16
    return found.withColumns({f"{w}_{c}": F.when(few, d).otherwise(F.col(f"{w}_{c}")).cast("long") for w, d in (("main", 255), ("outline", 0)) for c in "rgb"})


def colours_plausible():
    mean = lambda w: (F.col(f"{w}_r") + F.col(f"{w}_g") + F.col(f"{w}_b")) / 3.0
    return (mean("main") >= 155.0) & (mean("outline") <= 95.0)


def mask_plausible(count, area):
    return (count > 0) & (area > 0) & (count / F.nullif(area.cast("double"), F.lit(0.0)) < 0.30)


def tuned_frame(trials: DataFrame) -> DataFrame:
    """Per video the first frame whose colours and trial mask are plausible: idx and its colours.

    trials: video_id, idx, main_*, outline_*, mask_count, area.  A trial always starts from the untuned filter, so whether
    a frame qualifies does not depend on the frames before it, and the tuned frame is a minimum.
    """
    good = trials.filter(colours_plausible() & mask_plausible(F.col("mask_count"), F.col("area")))
    names = [f"{w}_{c}" for w in ("main", "outline") for c in "rgb"]
    first = good.groupBy("video_id").agg(F.min("idx").alias("tuned_idx"), F.min_by(F.struct(*names), "idx").alias("c"))
    return first.select("video_id", "tuned_idx", *[f"c.{n}" for n in names])
