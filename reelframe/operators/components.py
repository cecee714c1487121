"""Eight-connected components of masks and the clean-up rules that use them.

Masks travel one per row as arrays of set places, so a frame's pixels are gathered once (their number is bounded by the
frame) and labelled by an Arrow kernel; what follows is relational.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Postprocess
from .pixel import KEYS


def label_places(places: np.ndarray, width: int) -> np.ndarray:
    """The smallest place of each set pixel's component, by minimum propagation with pointer jumping."""
    places = np.unique(places)
    n = len(places)
    label = np.arange(n)
    links = []
    x = places % width
    for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
        ok = (x + dx >= 0) & (x + dx < width)
        to = places + dy * width + dx
        at = np.minimum(np.searchsorted(places, to), n - 1)
        hit = np.flatnonzero(ok & (places[at] == to))
        links.append((hit, at[hit]))
    a = np.concatenate([p[0] for p in links])
    b = np.concatenate([p[1] for p in links])
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return places[label]


def _label_batches(width: int):
    def run(batches):
        for b in batches:
            out = []
            for places in b.column("places").to_pylist():
                p = np.unique(np.array(places, np.int64))
                out.append([dict(pos=int(i), comp=int(c)) for i, c in zip(p, label_places(p, width), strict=True)] if len(p) else [])
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("comp", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in KEYS] + [pa.array(out, kind)], [*KEYS, "labelled"])

    return run


def label(hits: DataFrame, width: int) -> DataFrame:
    """Set pixels (video_id, idx, pos) -> the same with comp, the smallest place of the pixel's component."""
    rows = hits.groupBy(*KEYS).agg(F.collect_set(F.col("pos").cast("bigint")).alias("places"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEYS)
    done = rows.mapInArrow(_label_batches(width), f"{kinds}, labelled array<struct<pos:bigint,comp:bigint>>")
    return done.select(*KEYS, F.explode("labelled").alias("l")).select(*KEYS, "l.*")


def stats(labelled: DataFrame, width: int) -> DataFrame:
    """Area and bounding box of each component."""
    x, y = F.col("pos") % width, F.floor(F.col("pos") / width)
    return labelled.groupBy(*KEYS, "comp").agg(
        F.count("*").alias("area"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y")
    )


def is_dropped(cfg: Postprocess, width: int, height: int) -> Column:
    """Whether the clean-up drops a component given by its stats; rules that are off never enter the plan."""
    area = F.col("area")
    wide, high = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    rules = []
    if cfg.single_dot:
        rules.append(area == 1)
    if cfg.single_line:
        rules.append((area <= 4) & ((wide == 1) | (high == 1)))
    if cfg.large_block > 0:
        rules.append(area > cfg.large_block)
    if cfg.touch_edge:
        rules.append((F.col("min_x") == 0) | (F.col("min_y") == 0) | (F.col("max_x") == width - 1) | (F.col("max_y") == height - 1))
    if cfg.pass_center:
        low, high_ = int(height * (0.5 - cfg.center_tolerance)), int(height * (0.5 + cfg.center_tolerance))
        rules.append((F.col("min_y") < low) & (F.col("max_y") > high_))
    dropped = F.lit(False)
    for r in rules:
        dropped = dropped | r
    return dropped


def _keep(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    return labelled.join(kept.select(*KEYS, "comp"), [*KEYS, "comp"], "left_semi").select(*KEYS, "pos")


def clean(hits: DataFrame, cfg: Postprocess, width: int, height: int) -> DataFrame:
    """Set pixels without the components that the rules drop."""
    labelled = label(hits, width)
    return _keep(labelled, stats(labelled, width).filter(~is_dropped(cfg, width, height)))


def despeckle(hits: DataFrame, width: int, min_area: int) -> DataFrame:
    """Set pixels of components larger than min_area; 0 keeps all."""
    if min_area <= 0:
        return hits.select(*KEYS, "pos")
    labelled = label(hits, width)
    return _keep(labelled, labelled.groupBy(*KEYS, "comp").count().filter(F.col("count") > min_area))
