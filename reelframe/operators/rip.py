"""From frames to events with their boxes and images, on packed frames.

1. ``changes``: region of every frame, difference to the region before, and for change frames the region, the changed
   pixels and their colours, stored; other frames leave nothing but their number.
2. ``tuned``: per video, the first change frame whose colours and trial mask are plausible sets the filter's colours.
3. ``masks``: filter with dilation and clean-up of each change frame, by the colours that hold from the tuned frame on.
4. ``marked``: candidates, closes and filtered frames, by the mask of the change frame before.
5. ``segment`` and ``merge_repeats``: events; their images are cut from the region of their source frame.

Regions are exchanged at the borders of partitions and for the events' source frames only; masks take one bit a pixel.
"""

from __future__ import annotations

import time
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..shared import stored
from . import packed
from .detect import CHANGED_BELOW
from .masks import Packed
from .pixel import KEYS
from .segment import RANGE, chains, counted, merge_repeats, segment

#: Narrow rows (a video's colours, an event's frame) that may be broadcast, some 100 MB; beyond that both sides are shuffled.
FEW = 1_000_000


def _few(rows: DataFrame, counted_by: DataFrame) -> DataFrame:
    """rows, to be broadcast if the stored table that has as many is small: so that no region is shuffled to meet them."""
    return F.broadcast(rows) if counted_by.count() <= FEW else rows


def changes(frames: DataFrame, cfg: Config) -> DataFrame:
    """A row for each change frame, and rows that only count frames (see ``packed.compared``): changed, ratio, roi_w, roi_h,
    x0, y0, roi, change_mask, good (whether the colours and a trial mask are plausible), main and outline."""
    rip, base, post = cfg.rip, cfg.filter, cfg.postprocess

    def make():
        tuned = set()

        def work(video, idx, time, roi, before, x0, y0):
            changed = packed.changed_array(roi, before, rip.diff_threshold)
            n, area = int(np.count_nonzero(changed)), changed.size
            ratio = n / area if area else 0.0
            if n < rip.pixel_difference or ratio * 100.0 < rip.ignore_change_percent:
                return None
            good, main, outline = False, None, None
            if video not in tuned:  # later frames of the task cannot be the first one
                main, outline = packed.colours_array(roi, changed)
                if packed.plausible_colours(main, outline):
                    trial = np.count_nonzero(packed.clean_array(packed.filter_array(roi, base.tuned(main, outline)), post))
                    good = trial > 0 and trial / area < 0.30
                    if good:
                        tuned.add(video)
            return n, ratio, roi.shape[1], roi.shape[0], x0, y0, roi.tobytes(), Packed.pack(changed), good, main, outline

        return work

    fields = "changed:bigint;ratio:double;roi_w:int;roi_h:int;x0:int;y0:int;roi:binary;change_mask:binary;good:boolean;main:array<int>;outline:array<int>"
    return packed.compared(frames, cfg, make, fields)


def tuned(found: DataFrame) -> DataFrame:
    """video_id, tuned_idx and the colours main and outline of the videos that have a plausible frame."""
    return found.filter("good").groupBy("video_id").agg(F.min("idx").alias("tuned_idx"), F.min_by("main", "idx").alias("main"), F.min_by("outline", "idx").alias("outline"))


def masks(found: DataFrame, cfg: Config) -> DataFrame:
    """mask of each change frame (null: empty), and change_mask only where it is; stored."""
    colours = stored(tuned(found), "tuned")
    rows = found.filter("roi is not null").select(*KEYS, "time", "roi", "roi_w", "roi_h", "change_mask")
    rows = rows.join(_few(colours, colours), "video_id", "left")
    by_colours = F.col("idx") >= F.col("tuned_idx")
    rows = rows.select(*KEYS, "time", "roi", "roi_w", "roi_h", "change_mask", F.when(by_colours, F.col("main")).alias("main"), F.when(by_colours, F.col("outline")).alias("outline"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEYS)
    base, post = cfg.filter, cfg.postprocess

    def run(batches):
        filter_of = lru_cache(256)(lambda main, outline: base.tuned(main, outline) if main else base)
        for b in batches:
            out = []
            for roi, w, h, main, outline in zip(*[b.column(c) for c in ("roi", "roi_w", "roi_h", "main", "outline")], strict=True):
                own = filter_of(tuple(main.as_py() or ()), tuple(outline.as_py() or ()))
                out.append(Packed.pack(packed.clean_array(packed.filter_array(packed.frame_array(roi.as_py(), w.as_py(), h.as_py()), own), post)))
            empty = [None if m else c.as_py() for m, c in zip(out, b.column("change_mask"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*KEYS, "time")], pa.array(out, pa.binary()), pa.array(empty, pa.binary())], [*KEYS, "time", "mask", "change_mask"])

    return stored(rows.mapInArrow(run, f"{kinds}, time double, mask binary, change_mask binary"), "masks")


def marked(rows: DataFrame, below: float = CHANGED_BELOW) -> DataFrame:
    """kind (candidate, close or filtered) and mask of the change frames that have one, as ``detect.candidates``, with
    chain, the closes before them in their video; stored.

    Ranges of frames are compared apart; the last row of each goes to the next one too.
    """
    rows = rows.withColumns({"range_": F.floor(F.col("idx") / RANGE), "halo": F.lit(False)})
    last = rows.groupBy("video_id", "range_").agg(F.max("idx").alias("idx"))
    last = last.withColumn("next_", F.lead("range_").over(W.partitionBy("video_id").orderBy("range_"))).filter("next_ is not null")
    again = rows.drop("range_", "halo").join(stored(last.drop("range_"), "last-of-range"), KEYS)
    both = rows.unionByName(again.withColumnsRenamed({"next_": "range_"}).withColumn("halo", F.lit(True)))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEYS)

    def run(batches):
        key, before, closes = None, None, 0
        for b in batches:
            keep, kind, own, chain = [], [], [], []
            for k, (v, r, halo, mask, change) in enumerate(zip(*[b.column(c).to_pylist() for c in ("video_id", "range_", "halo", "mask", "change_mask")], strict=True)):
                if key != (v, r):
                    key, before, closes = (v, r), None, 0
                if not halo:
                    what = None
                    if mask is not None:
                        if before is None or Packed.share(Packed.read(before), Packed.read(mask)) < below:
                            what = "candidate"
                    elif before is not None:
                        what = "close"
                    elif change is not None:
                        what = "filtered"
                    if what:
                        keep.append(k), kind.append(what), own.append(change if what == "filtered" else mask), chain.append(closes)
                        closes += what == "close"
                before = mask
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in (*KEYS, "time", "range_")], pa.array(kind, pa.string()), pa.array(own, pa.binary()), pa.array(chain, pa.int64())], [*KEYS, "time", "range_", "kind", "mask", "chain"])

    found = both.repartition("video_id", "range_").sortWithinPartitions("video_id", "range_", "idx").mapInArrow(run, f"{kinds}, time double, range_ bigint, kind string, mask binary, chain bigint")
    found = stored(found, "marked")
    sums = found.groupBy("video_id", "range_").agg(F.count_if(F.col("kind") == "close").alias("closes"))
    earlier = W.partitionBy("video_id").orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("video_id", "range_", F.coalesce(F.sum("closes").over(earlier), F.lit(0)).alias("earlier_"))
    return found.join(stored(sums, "closes"), ["video_id", "range_"]).withColumn("chain", F.col("chain") + F.col("earlier_")).drop("range_", "earlier_")


def with_images(events: DataFrame, found: DataFrame) -> DataFrame:
    """events, which are stored, with roi_w, roi_h, roi_origin, bbox (x, y, width, height within the region) and image, the
    box cut from the region of the source frame.  Only those regions are exchanged."""
    names = events.columns
    wanted = events.select("video_id", F.col("source_frame").alias("idx")).distinct()
    rois = found.filter("roi is not null").select(*KEYS, "roi", "roi_w", "roi_h", "x0", "y0").join(_few(wanted, events), KEYS, "left_semi")
    both = events.join(rois.withColumnRenamed("idx", "source_frame"), ["video_id", "source_frame"]).select(*names, "roi", "roi_w", "roi_h", "x0", "y0")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)

    def run(batches):
        for b in batches:
            boxes, images = [], []
            for roi, mask, w, h in zip(*[b.column(c).to_pylist() for c in ("roi", "mask", "roi_w", "roi_h")], strict=True):
                x, y, bw, bh = box = Packed.box(Packed.unpack(mask, w, h))
                boxes.append(box), images.append(packed.frame_array(roi, w, h)[y : y + bh, x : x + bw].tobytes())
            origin = pa.array(list(zip(b.column("x0").to_pylist(), b.column("y0").to_pylist(), strict=True)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], b.column("roi_w"), b.column("roi_h"), origin, pa.array(boxes, pa.list_(pa.int32())), pa.array(images, pa.binary())], [*names, "roi_w", "roi_h", "roi_origin", "bbox", "image"])

    return both.mapInArrow(run, f"{kinds}, roi_w int, roi_h int, roi_origin array<int>, bbox array<int>, image binary")


def overlaid(earlier: dict, later: dict, union: np.ndarray) -> dict:
    """bbox and image of two events merged: the union's box of a black canvas on which the later image lies over the earlier."""
    w, h = earlier["roi_w"], earlier["roi_h"]
    x, y, bw, bh = box = Packed.box(Packed.unpack(union.tobytes(), w, h))
    canvas = np.zeros((bh, bw, 3), np.uint8)
    for e in (earlier, later):
        ex, ey, ew, eh = e["bbox"]
        image = np.frombuffer(e["image"], np.uint8).reshape(eh, ew, 3)
        # Boxes of the parts lie within the union's.
        canvas[ey - y : ey - y + eh, ex - x : ex - x + ew] = image[: max(y + bh - ey, 0), : max(x + bw - ex, 0)]
    return {"bbox": list(box), "image": canvas.tobytes(), "roi_w": w, "roi_h": h, "roi_origin": earlier["roi_origin"]}


def probe(frames: DataFrame, cfg: Config) -> DataFrame:
    """What a rip would make of each frame: n, mean, low and high of its channels, first (nine bytes), and beside the frame
    before changed, ratio, raw and clean (set pixels of the filter before and after the clean-up), main, outline, plausible."""
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in KEYS)

    def stats(batches):
        for b in batches:
            rows = [np.frombuffer(r, np.uint8) for r in b.column("rgb").to_pylist()]
            values = [[len(r) // 3 for r in rows], [float(r.mean()) if len(r) else None for r in rows], *[[int(f(r)) if len(r) else None for r in rows] for f in (np.min, np.max)], [r[:9].tobytes() for r in rows]]
            arrays = [pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in KEYS], *arrays], [*KEYS, "n", "mean", "low", "high", "first"])

    def make():
        def work(video, idx, time, roi, before, x0, y0):
            changed = packed.changed_array(roi, before, cfg.rip.diff_threshold)
            n, raw = int(np.count_nonzero(changed)), packed.filter_array(roi, cfg.filter)
            main, outline = packed.colours_array(roi, changed)
            return n, n / changed.size if changed.size else 0.0, int(np.count_nonzero(raw)), int(np.count_nonzero(packed.clean_array(raw, cfg.postprocess))), main, outline, packed.plausible_colours(main, outline)

        return work

    found = packed.compared(frames, cfg, make, "changed:bigint;ratio:double;raw:bigint;clean:bigint;main:array<int>;outline:array<int>;plausible:boolean")
    seen = frames.filter(~F.col("halo")) if "halo" in frames.columns else frames
    seen = seen.select(*KEYS, "rgb").mapInArrow(stats, f"{kinds}, n bigint, mean double, low bigint, high bigint, first binary")
    return seen.join(found.filter("changed is not null").drop("time", "frames"), KEYS, "left")


class Rip:
    """What a rip over frames gives: events, filtered events and a report, each made when it is first asked for."""

    def __init__(self, frames: DataFrame, cfg: Config, seconds: Column):
        self.cfg, self.seconds, self.seen = cfg, seconds, Observation()
        began = time.monotonic()
        read = F.count_if(~F.col("halo")) if "halo" in frames.columns else F.count("*")
        self.found = changes(frames.observe(self.seen, read.alias("frames_processed")), cfg)
        self.pass_s = time.monotonic() - began

    @cached_property
    def rows(self) -> DataFrame:
        return marked(masks(self.found, self.cfg)).withColumn("close_only", F.col("kind") == "close")

    def _segmented(self, rows: DataFrame) -> DataFrame:
        return segment(rows, self.seconds, self.cfg.rip.gap_frames, Packed, chain="chain", number=False)

    @cached_property
    def _unmerged(self) -> DataFrame:
        """Events before merging, without images; stored."""
        return self._segmented(self.rows.filter("kind <> 'filtered'"))

    @cached_property
    def _missed(self) -> DataFrame:
        """Filtered events without images; stored."""
        return self._segmented(self.rows.filter("kind = 'filtered'").withColumn("chain", F.lit(0)))

    def _merged(self, events: DataFrame, **more) -> DataFrame:
        return merge_repeats(events, F.lit(2.0) / self.seconds, force=self.cfg.rip.force_merge, masks=Packed, order="start_frame", **more)

    @cached_property
    def events(self) -> DataFrame:
        """video_id, event_no, start, end, start_frame, end_frame, n, mask, source_frame, roi_w, roi_h, roi_origin, bbox, image; repeats merged; stored."""
        events = self._unmerged
        # Chains are told apart on narrow rows, before the images join.
        cuts = chains(events.select("video_id", "start_frame", "start", "end"), F.lit(2.0) / self.seconds, "start_frame").select("video_id", "start_frame", "chain")
        pictured = with_images(events, self.found).join(cuts, ["video_id", "start_frame"]).select("video_id", *events.columns[1:], "roi_w", "roi_h", "roi_origin", "bbox", "image", "chain")
        return self._merged(pictured, blend=overlaid, chain="chain")

    @cached_property
    def filtered(self) -> DataFrame:
        """The same of the frames that changed without a mask, not merged."""
        pictured = with_images(self._missed, self.found)
        return counted(stored(pictured, "filtered"), "start_frame").select("video_id", "event_no", *pictured.columns[1:])

    def totals(self) -> dict:
        """frames_processed, as observed while the frames were read, and pass_s, the seconds of that pass."""
        return {"frames_processed": self.seen.get["frames_processed"], "pass_s": self.pass_s}

    def report(self) -> DataFrame:
        """Per video frames_processed, change_frames, events and filtered: one pass over the change rows and the events."""
        events = self.events if "events" in self.__dict__ else self._merged(self._unmerged)  # counts need no images
        counts = self.found.groupBy("video_id").agg(F.sum("frames").alias("frames_processed"), F.count("changed").alias("change_frames"))
        both = events.select("video_id", F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(self._missed.select("video_id", F.lit(0).alias("e"), F.lit(1).alias("f")))
        return counts.join(both.groupBy("video_id").agg(F.sum("e").alias("events"), F.sum("f").alias("filtered")), "video_id", "left").na.fill(0)


def rip(frames: DataFrame, cfg: Config, fps: float | Column = 25.0) -> Rip:
    """The whole run over frames (video_id, idx, rgb, width, height, and time or else idx / fps), already sampled.

    fps is a number or a column of video_id.  A video without events has no rows.
    """
    seconds = fps if isinstance(fps, Column) else F.lit(float(fps))
    return Rip(frames if "time" in frames.columns else frames.withColumn("time", F.col("idx") / seconds), cfg, seconds)
