"""Events from a live stream of candidates, with state per video.

The stream carries what ``operators.detect`` finds, in frame order within each video: video_id, idx, time, mask (places of
set pixels) and close_only.  The open event is the only state, so memory follows the number of videos, not their length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "video_id long, start double, end double, start_frame long, end_frame long, n long, mask array<long>"
STATE = "start double, start_frame long, last_time double, last_frame long, n long, mask array<long>"


def _overlap(a: set, b: set) -> float:
    both = len(a | b)
    return len(a & b) / both if both else 0.0


def segment_stream(candidates: DataFrame, fps: float = 25.0, gap: int = 5, joined_from: float = 0.7, idle: str = "1 hour") -> DataFrame:
    """Events as soon as they end: at a close, at a candidate that does not belong, or when a video has been idle.

    The rules and the results are those of ``operators.segment``; a batch's rows are put in frame order first, and rows
    older than the open event's last frame, which came too late, are ignored.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, frames, state: GroupState):
        done = []
        now = list(state.get) if state.exists else None

        def finish(end=None, frame=None):
            done.append((key[0], now[0], now[2] + 1 / fps if end is None else end, now[1], now[3] if frame is None else frame, now[4], sorted(now[5])))

        if state.hasTimedOut:
            finish()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("idx", kind="stable")
            for r in rows.itertuples():
                if now is not None and r.idx < now[3]:
                    continue
                if r.close_only:
                    if now is not None:
                        finish(r.time, r.idx)
                    now = None
                    continue
                mask = set(r.mask)
                if now is not None and not (_overlap(set(now[5]), mask) >= joined_from or r.idx - now[3] <= gap):
                    finish()
                    now = None
                if now is None:
                    now = [r.time, r.idx, r.time, r.idx, 1, sorted(mask)]
                else:
                    now[2:] = [r.time, r.idx, now[4] + 1, sorted(set(now[5]) | mask)]
            if now is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(now))
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(done, columns=["video_id", "start", "end", "start_frame", "end_frame", "n", "mask"])

    return candidates.groupBy("video_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
