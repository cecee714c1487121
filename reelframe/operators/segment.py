"""Order-dependent folds: candidates to events, and merging of repeated events.

A fold passes once over the rows of a chain in order and holds the open group only.  Chains are stretches of a video that
nothing can join: what lies between two closes, or events too far apart to merge.  They are told apart by running counts
over ranges of frames, so a long video spreads over tasks as far as it has closes or gaps.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import stored
from .masks import Bits

JOINED_FROM = 0.7
MERGED_FROM = 0.9
#: Frames, or events, of a video in a range of the running counts.
RANGE = 4096


def running(rows: DataFrame, value: Column, order: str, name: str, by: str = "video_id") -> DataFrame:
    """rows with the sum of value over the earlier rows of the same video, by sums within ranges of order and of ranges."""
    rows = rows.withColumns({"range_": F.floor(F.col(order) / RANGE), "value_": value.cast("long")})
    within = W.partitionBy(by, "range_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum("value_").over(within), F.lit(0).cast("long")))
    sums = rows.groupBy(by, "range_").agg(F.sum("value_").alias("sum_"))
    earlier = W.partitionBy(by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(by, "range_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0).cast("long")).alias("earlier_"))
    return rows.join(sums, [by, "range_"]).withColumn(name, F.col(name) + F.col("earlier_")).drop("range_", "value_", "earlier_")


def _fold(rows: DataFrame, order: str, start: Callable, schema: str) -> DataFrame:
    """rows (video_id, chain, ...) in order through start(): a function of a row, or of None at the end of a chain, to the
    group that it ends or None.  A group is a dictionary with the names of schema, of which video_id is filled in."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        step, key, types = start(), None, {}
        for b in batches:
            types = {f.name: f.type for f in b.schema}
            done = []
            for row in b.to_pylist():
                if key is not None and key != (row["video_id"], row["chain"]) and (group := step(None)):
                    done.append(group | {"video_id": key[0]})
                key = row["video_id"], row["chain"]
                if group := step(row):
                    done.append(group | {"video_id": key[0]})
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], types.get(n, pa.int64())) for n in names], names)
        if key is not None and (group := step(None)):
            group["video_id"] = key[0]
            yield pa.RecordBatch.from_arrays([pa.array([group[n]], types.get(n, pa.int64())) for n in names], names)

    return rows.repartition("video_id", "chain").sortWithinPartitions("video_id", "chain", order).mapInArrow(run, schema)


def counted(groups: DataFrame, order: str) -> DataFrame:
    """groups, which are stored, with event_no, their number within the video."""
    return running(groups, F.lit(1), order, "no_").withColumn("event_no", (F.col("no_") + 1).cast("int")).drop("no_")


def segment(rows: DataFrame, fps: Column | float = 25.0, gap: int = 5, masks=Bits, joined_from: float = JOINED_FROM, chain: str | None = None, number: bool = True) -> DataFrame:
    """Candidates and closes (video_id, idx, time, mask, close_only) -> events.

    A candidate joins the open event if it overlaps the union of its masks by joined_from or follows its last candidate
    within gap frames; else the event ends one frame after its last candidate and a new one opens.  A close ends the open
    event at its own time.  chain, if given, is a column with the number of closes before the row.
    Returns video_id, event_no (from 1, if number), start, end, start_frame, end_frame, n, mask, source_frame, stored.
    """
    seconds = fps if isinstance(fps, Column) else F.lit(float(fps))
    columns = ["video_id", F.col("idx").cast("long").alias("idx"), F.col("time").cast("double").alias("time"), "mask", "close_only", (F.lit(1.0) / seconds).alias("frame_s")]
    rows = rows.select(*columns, F.col(chain).alias("chain")) if chain else running(stored(rows.select(*columns), "candidates"), F.col("close_only").cast("int"), "idx", "chain")

    def start():
        event, union = {}, None

        def finish(**close):
            nonlocal event
            done, event = event, {}
            frame_s = done.pop("frame_s")
            return done | {"mask": masks.write(union), "end": done["time"] + frame_s, "end_frame": done["source_frame"]} | close

        def step(row):
            nonlocal event, union
            done = None
            if row is None or row["close_only"]:
                return None if not event else finish(end=row["time"], end_frame=row["idx"]) if row else finish()
            mask = masks.read(row["mask"])
            if event and (masks.share(union, mask) >= joined_from or row["idx"] - event["source_frame"] <= gap):
                union = masks.joined(union, mask)
            else:
                done = finish() if event else None
                event, union = {"start": row["time"], "start_frame": row["idx"], "n": 0}, mask
            event |= {"time": row["time"], "frame_s": row["frame_s"], "source_frame": row["idx"], "n": event["n"] + 1}
            return done

        return step

    kind = rows.schema["video_id"].dataType.simpleString()
    # time and the columns named like input ones take those columns' types; start and end are doubles like time.
    rows = rows.withColumns({"start": F.lit(0.0), "end": F.lit(0.0)})
    events = _fold(rows, "idx", start, f"video_id {kind}, start double, end double, start_frame bigint, end_frame bigint, n bigint, mask {masks.kind}, source_frame bigint")
    events = stored(events, "events")
    return counted(events, "start_frame").select("video_id", "event_no", *events.columns[1:]) if number else events


def chains(events: DataFrame, max_gap: Column | float, order: str) -> DataFrame:
    """events with chain: one more wherever an event begins more than max_gap seconds after the one before it ends."""
    gap = max_gap if isinstance(max_gap, Column) else F.lit(float(max_gap))
    in_order = W.partitionBy("video_id").orderBy(order)
    cut = F.coalesce((F.col("start") - F.lag("end").over(in_order) > gap).cast("int"), F.lit(0))
    return events.withColumn("cut_", cut).withColumn("chain", F.sum("cut_").over(in_order)).drop("cut_")


def merge_repeats(
    events: DataFrame, max_gap: Column | float, merged_from: float = MERGED_FROM, force: bool = False, masks=Bits, sums: tuple[str, ...] = ("n",), blend: Callable | None = None,
    order: str = "event_no", chain: str | None = None,
) -> DataFrame:
    """Neighbouring events (video_id, event_no, start, end, ..., mask) that repeat become one.

    An event joins the one before if their masks overlap by merged_from (the earlier as merged so far) and it begins at most
    max_gap seconds after that one's end; force joins all of a video.  The merged event keeps the first start, takes the
    last end and source frame, adds up the sums and unites the masks; blend(earlier, later, union) -> further values.
    order is the column that puts a video's events in order, and chain, if given, one as ``chains`` makes it.
    """
    columns = [c for c in events.columns if c != chain]
    gap = max_gap if isinstance(max_gap, Column) else F.lit(float(max_gap))
    rows = events.withColumn("chain", F.lit(0)) if force else events if chain else chains(events, max_gap, order)
    rows = rows.withColumn("gap_", gap)
    first = ("video_id", order, "start", "start_frame")

    def start():
        event, union = None, None

        def step(row):
            nonlocal event, union
            done = None
            if row is not None:
                mask = masks.read(row["mask"])
                if event is not None and (force or (masks.share(union, mask) >= merged_from and row["start"] - event["end"] <= row["gap_"])):
                    union = masks.joined(union, mask)
                    more = blend(event, row, union) if blend else {}
                    event = {c: event[c] if c in first else event[c] + row[c] if c in sums else row[c] for c in columns} | more
                    return None
            if event is not None:
                done = event | {"mask": masks.write(union)}
            event, union = (None, None) if row is None else ({c: row[c] for c in columns}, mask)
            return done

        return step

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in columns)
    merged = stored(_fold(rows, order, start, kinds).withColumnRenamed("event_no", "old_no"), "merged")
    return counted(merged, "old_no" if order == "event_no" else order).select("video_id", "event_no", *[c for c in columns if c not in ("video_id", "event_no")])
