"""The whole rip over a stream of frames: the state of a video is the region, mask and colours of its last frame, the open
event, the ended event that may still merge with the next one, and frames that came before their turn.

Rules and results are those of ``operators.rip``.  The session needs the RocksDB state store, which keeps state off the
heap: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..config import Config
from ..operators import packed
from ..operators.detect import CHANGED_BELOW
from ..operators.masks import Packed
from ..operators.rip import overlaid
from ..operators.segment import JOINED_FROM, MERGED_FROM

EVENT = "start double, end double, start_frame long, end_frame long, n long, mask binary, source_frame long, roi_w int, roi_h int, roi_origin array<int>, bbox array<int>, image binary"
_NAMES = [c.split()[0] for c in EVENT.split(", ")]
#: Frames of a video that may wait for an earlier one; with more, the missing one counts as lost.
WAITING = 512


class RipProcessor(StatefulProcessor):
    """Frames of one video -> its events as soon as nothing can join them any more."""

    def __init__(self, cfg: Config, fps: float, first: int, idle_ms: int):
        self.cfg, self.fps, self.first, self.idle_ms = cfg, fps, first, idle_ms
        self.step, self.gap_s = max(cfg.rip.frame_skip, 1), 2.0 / fps

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "idx long, time double, width int, height int, region binary, mask binary")
        self.colours = handle.getValueState("colours", "main array<int>, outline array<int>")
        self.open = handle.getValueState("open", "start double, start_frame long, time double, source_frame long, n long, mask binary, width int, height int, x0 int, y0 int, region binary")
        self.ended = handle.getValueState("ended", EVENT)
        self.early = handle.getMapState("early", "idx long", "time double, width int, height int, rgb binary")

    def close(self) -> None:
        pass

    # Rows of state as plain tuples; None where there is none.
    def _get(self, state):
        return tuple(state.get()) if state.exists() else None

    def handleInputRows(self, key, rows, timerValues):
        done = []
        last = self._get(self.last)
        for r in rows:
            if last is None or r.idx > last[0]:
                self.early.updateValue((r.idx,), (r.time, r.width, r.height, bytes(r.rgb)))
        waiting = sorted(k[0] for k in self.early.keys())
        while waiting:
            wanted = self.first if last is None else last[0] + self.step
            if waiting[0] > wanted and len(waiting) <= WAITING:
                break
            last = self._frame(waiting.pop(0), last, done)
        if last is not None:
            self.last.update(last)
            self._settle(last[1], done)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Nothing came for a while: frames that wait are taken as they are, and everything ends."""
        done = []
        last = self._get(self.last)
        for idx in sorted(k[0] for k in self.early.keys()):
            last = self._frame(idx, last, done)
        if last is not None:
            self.last.update(last)
        if self.open.exists():
            self._finish(done)
        if self.ended.exists():
            done.append(self._get(self.ended))
            self.ended.clear()
        return self._rows(key, done)

    def _rows(self, key, done):
        for values in done:
            yield pd.DataFrame([(key[0], *values)], columns=["video_id", *_NAMES])

    def _frame(self, idx, last, done):
        """One frame in its turn; returns what is kept of it."""
        time, w, h, rgb = tuple(self.early.getValue((idx,)))
        self.early.removeKey((idx,))
        cfg = self.cfg
        roi, x0, y0 = packed.region(packed.frame_array(rgb, w, h), cfg)
        mask_before = last[5] if last else None
        mask = mask_before
        if last is not None and (last[3], last[2]) == roi.shape[:2]:
            changed = packed.changed_array(roi, packed.frame_array(last[4], last[2], last[3]), cfg.rip.diff_threshold)
            n, area = int(np.count_nonzero(changed)), changed.size
            if area and n >= cfg.rip.pixel_difference and n / area * 100.0 >= cfg.rip.ignore_change_percent:
                mask = self._mask(roi, changed)
                if mask is None:
                    if mask_before is not None and self.open.exists():
                        self._finish(done, time, idx)
                elif mask_before is None or Packed.share(Packed.read(mask_before), Packed.read(mask)) < CHANGED_BELOW:
                    self._candidate(idx, time, mask, roi, x0, y0, done)
        return idx, time, roi.shape[1], roi.shape[0], roi.tobytes(), mask

    def _mask(self, roi, changed):
        base, post = self.cfg.filter, self.cfg.postprocess
        found = self._get(self.colours)
        if found is None:
            main, outline = packed.colours_array(roi, changed)
            if packed.plausible_colours(main, outline):
                trial = packed.clean_array(packed.filter_array(roi, base.tuned(main, outline)), post)
                if 0 < np.count_nonzero(trial) / trial.size < 0.30:
                    self.colours.update((list(main), list(outline)))
                    return Packed.pack(trial)
        else:
            base = base.tuned(tuple(found[0]), tuple(found[1]))
        return Packed.pack(packed.clean_array(packed.filter_array(roi, base), post))

    def _candidate(self, idx, time, mask, roi, x0, y0, done):
        event = self._get(self.open)
        if event is not None:
            union, own = Packed.read(event[5]), Packed.read(mask)
            if Packed.share(union, own) >= JOINED_FROM or idx - event[3] <= self.cfg.rip.gap_frames:
                self.open.update((*event[:2], time, idx, event[4] + 1, Packed.joined(union, own).tobytes(), *event[6:10], roi.tobytes()))
                return
            self._finish(done)
        self.open.update((time, idx, time, idx, 1, mask, roi.shape[1], roi.shape[0], x0, y0, roi.tobytes()))

    def _finish(self, done, end=None, end_frame=None):
        """Ends the open event; it merges with the one that ended before, or that one is done."""
        start, first, time, source, n, mask, w, h, x0, y0, region = self._get(self.open)
        self.open.clear()
        x, y, bw, bh = box = Packed.box(Packed.unpack(mask, w, h))
        image = packed.frame_array(region, w, h)[y : y + bh, x : x + bw].tobytes()
        event = (start, time + 1.0 / self.fps if end is None else end, first, source if end_frame is None else end_frame, n, mask, source, w, h, [x0, y0], list(box), image)
        before = self._get(self.ended)
        if before is not None:
            a, b = dict(zip(_NAMES, before, strict=True)), dict(zip(_NAMES, event, strict=True))
            share = Packed.share(Packed.read(a["mask"]), Packed.read(b["mask"]))
            if self.cfg.rip.force_merge or share >= MERGED_FROM and b["start"] - a["end"] <= self.gap_s:
                union = Packed.joined(Packed.read(a["mask"]), Packed.read(b["mask"]))
                both = b | {"start": a["start"], "start_frame": a["start_frame"], "n": a["n"] + b["n"], "mask": union.tobytes()} | overlaid(a, b, union)
                event = tuple(both[c] for c in _NAMES)
            else:
                done.append(before)
        self.ended.update(event)

    def _settle(self, now, done):
        """The ended event is done if what is open, or whatever may begin from now on, begins too late to merge with it."""
        before = self._get(self.ended)
        if before is None or self.cfg.rip.force_merge:
            return
        begins = self._get(self.open)[0] if self.open.exists() else now
        if begins - before[1] > self.gap_s:
            done.append(before)
            self.ended.clear()


def rip_stream(frames: DataFrame, cfg: Config, fps: float = 25.0, first: int = 0, idle: str = "1 hour") -> DataFrame:
    """Events of a stream of frames (video_id, idx, time, width, height, rgb), sampled already; first is the first frame.

    Frames may come in any order: one that comes early waits in the state for those before it, up to WAITING of them, and
    one that comes after its turn is ignored.  A video that has been idle ends its open event, as a batch's end does.
    """
    kind = frames.schema["video_id"].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = frames.select("video_id", "idx", "time", "width", "height", "rgb")
    return rows.groupBy("video_id").transformWithStateInPandas(_InPandas(cfg, fps, first, idle_ms), f"video_id {kind}, {EVENT}", "Append", "ProcessingTime")


class _InPandas(RipProcessor):
    """The processor on batches of rows as pandas frames."""

    def handleInputRows(self, key, rows, timerValues):
        return super().handleInputRows(key, (r for part in rows for r in part.itertuples(index=False)), timerValues)
