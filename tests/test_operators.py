"""Operators on small inputs, against row-by-row models and the known intervals of a synthetic clip."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.config import ColorSegment, Config, Filter, Postprocess, hue_of
from reelframe.operators import components, detect, diff, packed, pixel, render
from reelframe.operators.masks import Bits, Packed, Places
from reelframe.operators.rip import rip
from reelframe.operators.segment import merge_repeats, running, segment


def test_config_round_trip_and_defaults():
    cfg = Config.from_json('{"rip": {"gap_frames": 9}, "unknown": 1, "filter": {"segments": {"final": {"rgb": [1, 2, 3]}}}}')
    assert cfg.rip.gap_frames == 9 and cfg.rip.diff_threshold == 24 and cfg.filter.segments["final"].rgb == (1, 2, 3)
    assert Config.from_json(cfg.to_json()) == cfg
    with pytest.raises(TypeError):
        Config.from_json('{"rip": {"gap_frames": "many"}}')


def test_roi_scale():
    assert Config().roi_scale() == 1.0
    for scale, want in ((2.0, 2.0), (0.5, 0.5)):
        assert Config.from_json(json.dumps({"region": {"scale": scale}})).roi_scale() == want


def test_active_segments():
    on, off = ColorSegment(), ColorSegment(enable_rgb=False)
    assert len(Filter().active_segments()) == 2
    assert Filter(method="x", segments={"pass1": on, "final": off}).active_segments() == [on]
    assert Filter(method="x", segments={"pass1": on, "final": on}).active_kinds() == ["final", "pass1"]
    tuned = Filter().tuned((250, 240, 10), (0, 10, 20))
    assert tuned.segments["final"].rgb == (250, 240, 10) and tuned.segments["outline"].hue == hue_of((0, 10, 20))


@pytest.mark.parametrize("count,area,want", [(1, 4, True), (1, 3, False), (0, 16, False), (16, 16, False), (30, 100, False), (29, 100, True), (0, 0, False)])
def test_mask_plausible(spark, count, area, want):
    row = spark.createDataFrame([(count, area)], "c int, a int").select(detect.mask_plausible(F.col("c"), F.col("a")).alias("p")).first()
    assert bool(row.p) is want


def test_despeckle_keeps_large_components():
    rows = ["......", ".##...", ".##...", ".##...", "......", "....#.", "#....."]
    mask = np.array([[c == "#" for c in r] for r in rows])
    assert render.despeckle_array(mask, 4).sum() == 6
    assert render.despeckle_array(mask, 6).sum() == 0
    assert (render.despeckle_array(mask, 0) == mask).all()


def naive_segments(rows, fps=25.0, gap=5):
    events, cur = [], []

    def close(at=None):
        union = 0
        for r in cur:
            union |= r[2]
        events.append((cur[0][1], at[1] if at else cur[-1][1] + 1 / fps, cur[0][0], at[0] if at else cur[-1][0], len(cur), union))
        cur.clear()

    for r in rows:
        if r[3]:
            if cur:
                close(r)
            continue
        if cur:
            union = 0
            for c in cur:
                union |= c[2]
            any_ = (union | r[2]).bit_count()
            if not ((any_ and (union & r[2]).bit_count() / any_ >= 0.7) or r[0] - cur[-1][0] <= gap):
                close()
        cur.append(r)
    if cur:
        close()
    return events


def test_segment_follows_a_row_by_row_model(spark):
    rnd, data = random.Random(3), []
    for v in range(60):
        idx = 0
        for _ in range(rnd.randint(0, 14)):
            idx += rnd.choice([1, 2, 5, 6, 9, 20])
            data.append((v, idx, idx / 25.0, rnd.choice([0b111111, 0b111110, 0b000011, rnd.randint(1, 63)]), rnd.random() < 0.2))
    frame = spark.createDataFrame(data, "video_id long, idx long, time double, mask long, close_only boolean")
    got = {}
    for r in segment(frame).orderBy("video_id", "event_no").collect():
        got.setdefault(r.video_id, []).append((r.start, r.end, r.start_frame, r.end_frame, r.n, r["mask"]))
    for v in range(60):
        want = naive_segments([d[1:] for d in data if d[0] == v])
        assert got.get(v, []) == [pytest.approx(w) for w in want]


def test_places_and_bits_agree(spark):
    rnd = random.Random(5)
    data = [(v, i * rnd.randint(1, 4), i / 25.0, rnd.randint(1, 255), rnd.random() < 0.2) for v in range(10) for i in range(1, 12)]
    data = list({(d[0], d[1]): d for d in data}.values())
    bits = spark.createDataFrame(data, "video_id long, idx long, time double, mask long, close_only boolean")
    places = bits.withColumn("mask", F.expr("filter(sequence(0L, 7L), p -> (shiftright(mask, cast(p as int)) & 1) = 1)"))
    columns = ["video_id", "event_no", "start", "end", "start_frame", "end_frame", "n"]
    a = merge_repeats(segment(bits), 0.5).select(columns).orderBy("video_id", "event_no").collect()
    b = merge_repeats(segment(places, masks=Places), 0.5, masks=Places).select(columns).orderBy("video_id", "event_no").collect()
    assert a == b


def test_iou_of_empty_masks_is_zero(spark):
    row = spark.range(1).select(Bits.iou(F.lit(0), F.lit(0)).alias("a"), Places.iou(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")).alias("b")).first()
    assert (row.a, row.b) == (0.0, 0.0)


def clip(w=64, h=36, frames=125, fps=25):
    """A drifting gradient with white rectangles for text in three half-open intervals."""
    rng = np.random.default_rng(1)
    out = []
    for i in range(frames):
        t = i / fps
        y, x = np.mgrid[0:h, 0:w]
        rgb = np.stack([70 + 45 * np.sin(3 * t + y / 5), 70 + 45 * np.cos(2.4 * t + y / 7), 80 + 40 * np.sin(1.8 * t + (y + 10) / 8)], 2) + 0 * x[..., None]
        rgb = rgb + 60 * (rng.random((h, w, 1)) < 0.5) * ((x // 8 + i) % 2 == 0)[..., None]
        for k, (a, b) in enumerate(((0.5, 1.5), (2.0, 3.0), (3.5, 4.7))):
            if a <= t < b:
                rgb[26:32, 10 + 5 * k : 30 + 9 * k] = 255
        out.append((0, i, t, w, h, np.clip(rgb, 0, 255).astype(np.uint8).tobytes()))
    return out


FRAMES = "video_id long, idx long, time double, width int, height int, rgb binary"


def sample(frames=125, fps=25, w=160, h=90):
    """A sample clip: a drifting gradient, a moving box, and white glyphs with black
    strokes in three half-open intervals.  Returns the frames and the box of each text, strokes included."""
    y, x = np.mgrid[0:h, 0:w]
    out, boxes = [], [(60, 76, 34, 8), (58, 77, 40, 7), (50, 76, 58, 8)]
    for i in range(frames):
        t = i / fps
        wave = 8 * y + 0 * x
        rgb = np.stack([70 + 45 * np.sin(t * 3 + wave / 55), 70 + 45 * np.cos(t * 2.4 + wave / 75), 80 + 40 * np.sin(t * 1.8 + (wave + 100) / 85)], 2).astype(np.uint8)
        bx, by = int((w * 0.7 + t * 52.5) % (w - 15)), int((h * 0.35 + t * 32.5) % (h - 15))
        rgb[by : by + 12, bx : bx + 14] = (180, 90, 120)
        rgb[((x - bx - 7) / 4.5) ** 2 + ((y - by - 5.5) / 3.8) ** 2 <= 1] = (90, 180, 160)
        for (a, b), (tx, ty, tw, th) in zip(((0.5, 1.5), (2.0, 3.0), (3.5, 4.7)), boxes, strict=True):
            if a <= t < b:
                for gx in range(tx, tx + tw - 5, 6):
                    rgb[ty : ty + th, gx : gx + 6 + (gx + 12 > tx + tw) * (tx + tw - gx - 6)] = 0
                    rgb[ty + 1 : ty + th - 1, gx + 1 : gx + 5] = 255
        out.append((0, i, t, w, h, rgb.tobytes()))
    return out, boxes


def check_sample(events, boxes):
    events = sorted(events, key=lambda e: e.event_no)
    assert [(e.start_frame, e.end_frame, e.n, e.source_frame) for e in events] == [(13, 38, 1, 13), (50, 75, 1, 50), (88, 118, 1, 88)]
    assert [(e.start, e.end) for e in events] == [(0.52, 1.52), (2.0, 3.0), (3.52, 4.72)]
    for e, (x, y, w, h) in zip(events, boxes, strict=True):  # one pixel of compensation around the strokes
        assert list(e.bbox) == [x - 1, y - 1, w + 2, h + 2] and len(e.image) == e.bbox[2] * e.bbox[3] * 3 and e.roi_origin == [0, 0]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_sample_clip_gives_the_known_intervals(spark, parts):
    """With the default configuration, whatever the partitions; in the second case two videos are mixed over them."""
    data, boxes = sample()
    frames = spark.createDataFrame(data, FRAMES)
    if parts == 3:
        frames = frames.unionByName(frames.withColumn("video_id", F.lit(1).cast("long"))).repartition(3, "rgb")
    found = rip(frames if parts == 3 else frames.repartitionByRange(parts, "idx"), Config())
    for video in range(1 + (parts == 3)):
        check_sample(found.events.filter(F.col("video_id") == video).collect(), boxes)
    assert found.totals()["frames_processed"] == 125 * (1 + (parts == 3))
    assert {r.frames_processed for r in found.report().collect()} == {125}


def naive_rip(frames, cfg):
    """The rip frame by frame, with one open state, on arrays."""
    before = before_mask = None
    colours, rows, filtered = cfg.filter, [], []
    tuned = False
    for _, i, t, w, h, rgb in frames:
        roi, x0, y0 = packed.region(packed.frame_array(rgb, w, h), cfg)
        if before is not None:
            changed = np.abs(roi.astype(int) - before.astype(int)).max(-1) > cfg.rip.diff_threshold
            if changed.sum() >= cfg.rip.pixel_difference and changed.mean() * 100 >= cfg.rip.ignore_change_percent:
                mask = None
                if not tuned:
                    main, outline = packed.colours_array(roi, changed)
                    if sum(main) / 3 >= 155 and sum(outline) / 3 <= 95:
                        trial = packed.clean_array(packed.filter_array(roi, colours.tuned(main, outline)), cfg.postprocess)
                        if 0 < trial.mean() < 0.3:
                            mask, tuned, colours = trial, True, colours.tuned(main, outline)
                if mask is None:
                    mask = packed.clean_array(packed.filter_array(roi, colours), cfg.postprocess)
                if mask.any():
                    if before_mask is None or (before_mask & mask).sum() / (before_mask | mask).sum() < 0.7:
                        rows.append((i, t, mask, roi, False))
                    before_mask = mask
                elif before_mask is not None:
                    rows.append((i, t, None, None, True))
                    before_mask = None
                elif changed.any():
                    filtered.append((i, t, changed, roi, False))
        before = roi
    return rows, filtered


def naive_events(rows, fps, gap, merging=True):
    events, cur = [], []

    def close(at=None):
        union = np.any([r[2] for r in cur], axis=0)
        y, x = np.nonzero(union)
        box = x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1
        image = cur[-1][3][box[1] : box[1] + box[3], box[0] : box[0] + box[2]]
        events.append({"start": cur[0][1], "end": at[1] if at else cur[-1][1] + 1 / fps, "sf": cur[0][0], "ef": at[0] if at else cur[-1][0], "n": len(cur), "mask": union, "box": box, "image": image, "src": cur[-1][0]})
        cur.clear()

    for r in rows:
        if r[4]:
            if cur:
                close(r)
            continue
        if cur:
            union = np.any([c[2] for c in cur], axis=0)
            if not ((union & r[2]).sum() / (union | r[2]).sum() >= 0.7 or r[0] - cur[-1][0] <= gap):
                close()
        cur.append(r)
    if cur:
        close()
    merged = []
    for e in events:
        p = merged[-1] if merged else None
        if merging and p and (p["mask"] & e["mask"]).sum() / (p["mask"] | e["mask"]).sum() >= 0.9 and e["start"] - p["end"] <= 2 / fps:
            canvas = np.zeros((*p["mask"].shape, 3), np.uint8)
            for q in (p, e):
                x, y, w, h = q["box"]
                canvas[y : y + h, x : x + w] = q["image"]
            p["mask"] = p["mask"] | e["mask"]
            y, x = np.nonzero(p["mask"])
            p["box"] = x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1
            p["image"] = canvas[p["box"][1] : p["box"][1] + p["box"][3], p["box"][0] : p["box"][0] + p["box"][2]]
            p |= {"end": e["end"], "ef": e["ef"], "n": p["n"] + e["n"], "src": e["src"]}
        else:
            merged.append(e)
    return merged


@pytest.mark.parametrize("cfg,parts", [
    ('{"region": {"up": 3, "down": 2, "left": 4, "right": 1}}', 5),
    ('{"region": {"scale": 0.5, "sharpen": true, "up": 1}, "rip": {"gap_frames": 2}, "postprocess": {"pass_center": false}}', 4),
    ('{"region": {"scale": 1.5}, "rip": {"diff_threshold": 10}, "filter": {"pixel_compensate": 2}, "postprocess": {"single_dot": false, "large_block": 900}}', 3),
])
def test_rip_equals_a_frame_by_frame_model(spark, monkeypatch, cfg, parts):
    """Also with ranges of seven frames, so that candidates and closes meet their predecessors across many ranges."""
    monkeypatch.setattr("reelframe.operators.segment.RANGE", 7)
    monkeypatch.setattr("reelframe.operators.rip.RANGE", 7)
    cfg = Config.from_json(cfg)
    rng, frames = np.random.default_rng(5), clip(48, 36, 90)
    flicker = []  # blinking, growing and moving rectangles make merges, closes and changes
    for v, i, t, w, h, rgb in frames:
        a = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).copy()
        if i % 20 in (3, 4, 5, 7, 8, 9, 13, 14, 16):
            a[24:31, 6 : 30 + i % 3] = 250
        if i % 20 == 18:
            a[5:9, 20 : 30 + int(rng.integers(8))] = 255
        flicker.append((v, i, t, w, h, a.tobytes()))
    found = rip(spark.createDataFrame(flicker, FRAMES).repartitionByRange(parts, "idx"), cfg)
    rows, filtered = naive_rip(flicker, cfg)
    for got, want in ((found.events, naive_events(rows, 25.0, cfg.rip.gap_frames)), (found.filtered, naive_events(filtered, 25.0, cfg.rip.gap_frames, merging=False))):
        got = got.orderBy("event_no").collect()
        assert [(e.start, e.end, e.start_frame, e.end_frame, e.n, e.source_frame) for e in got] == [(w["start"], pytest.approx(w["end"]), w["sf"], w["ef"], w["n"], w["src"]) for w in want]
        for e, w in zip(got, want, strict=True):
            assert Packed.unpack(e.mask, e.roi_w, e.roi_h).tolist() == w["mask"].tolist() and tuple(e.bbox) == tuple(w["box"]) and bytes(e.image) == w["image"].tobytes()
    assert rows


def test_packed_and_long_forms_agree(spark):
    data = [f for f in clip(16, 12, 12)]
    frames = spark.createDataFrame(data, FRAMES)
    long = packed.to_pixels(frames)
    cfg = Filter(segments={"outline": ColorSegment(rgb=(60, 60, 60), rgb_diff=40), "final": ColorSegment(rgb=(120, 120, 120), rgb_diff=40)})
    a = components.clean(pixel.mask_pixels(long, cfg, 16, 12), Postprocess(), 16, 12)
    masks = packed.filter_masks(frames, cfg, Postprocess()).filter("mask is not null").collect()
    assert sorted(map(tuple, a.collect())) == sorted((r.video_id, r.idx, int(p)) for r in masks for p in np.flatnonzero(Packed.unpack(r.mask, 16, 12)))
    a = diff.change_counts(diff.pixel_changes(long)).select("idx", "changed", "n")
    b = packed.frame_differences(frames, 24).select("idx", F.col("changed"), "n")
    assert sorted(a.collect()) == sorted(b.collect())


def test_region_kernels_equal_the_long_form(spark):
    frames = spark.createDataFrame(clip(16, 12, 2), FRAMES)
    long = packed.to_pixels(frames)
    for region in ({"up": 1, "left": 2, "right": 3}, {"scale": 1.5}, {"scale": 0.3, "down": 2}, {"up": 1, "sharpen": True}, {"up": 20}):
        cfg = Config.from_json(json.dumps({"region": region}))
        r = cfg.region
        want = pixel.crop(long, 16, 12, r.up, r.down, r.left, r.right)
        w, h = 16 - r.left - r.right, max(12 - r.up - r.down, 0)
        if r.scale:
            want, w, h = pixel.scale_nearest(want, w, h, r.scale), int(w * r.scale), int(h * r.scale)
        if r.sharpen:
            want = pixel.sharpen(want, w, h)
        got = {}
        for f in frames.collect():
            own, x0, y0 = packed.region(packed.frame_array(f.rgb, 16, 12), cfg)
            assert own.shape == (h, w, 3) and (x0, y0) == (r.left, min(r.up, 12))
            got |= {(f.idx, p): tuple(int(v) for v in own.reshape(-1, 3)[p]) for p in range(w * h)}
        assert got == {(p.idx, p.pos): (p.r, p.g, p.b) for p in want.collect()}


def test_colours_equal_the_long_form(spark):
    frames = spark.createDataFrame(clip(16, 12, 6), FRAMES)
    changes = diff.pixel_changes(packed.to_pixels(frames)).filter("changed")
    rows = {f.idx: packed.frame_array(f.rgb, 16, 12) for f in frames.collect()}
    for r in detect.auto_colours(changes).collect():
        main, outline = packed.colours_array(rows[r.idx], packed.changed_array(rows[r.idx], rows[r.idx - 1], 24))
        assert main == (r.main_r, r.main_g, r.main_b) and outline == (r.outline_r, r.outline_g, r.outline_b)


def test_no_region_of_a_video_is_exchanged_in_order(spark):
    """Frames in ranges: only borders meet; the stored rows are those of one pass."""
    frames = spark.createDataFrame(clip(16, 12, 60), FRAMES).repartitionByRange(4, "idx")
    plan = packed.frame_differences(frames)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "rgb" not in plan


def test_running_counts(spark, monkeypatch):
    monkeypatch.setattr("reelframe.operators.segment.RANGE", 5)
    rnd = random.Random(2)
    data = [(v, i, rnd.randint(0, 3)) for v in range(4) for i in rnd.sample(range(60), 30)]
    got = running(spark.createDataFrame(data, "video_id int, idx long, x int"), F.col("x"), "idx", "before").collect()
    assert len(got) == len(data) and all(r.before == sum(x for v, i, x in data if v == r.video_id and i < r.idx) for r in got)


def test_render_kernels():
    mask = np.zeros((10, 20), bool)
    mask[2:8, 3:17] = True
    tile = render.tile(mask, scale=2.0, despeckle=0)
    assert tile.shape == (20, 40, 3) and tile[8, 20].tolist() == [0, 0, 0] and tile[0, 0].tolist() == [255, 255, 255]
    assert len(np.unique(tile)) > 2 and set(np.unique(render.tile(mask, mode="binary"))) <= {0, 255}
    assert render.png(tile)[:8] == b"\x89PNG\r\n\x1a\n" and render.bmp(tile)[:2] == b"BM"
    assert (render.turn(render.turn(tile, "cw"), "ccw") == tile).all()
    joined = render.side_by_side([tile, tile])
    assert joined.shape == (20, 4 + 44 + 44, 3)
    two = np.zeros((30, 10, 3), np.uint8)
    two[12:18] = 255
    assert render.blank_split(two) == 14
    assert render.blank_split(np.zeros((30, 10, 3), np.uint8)) is None
    assert render.polygon(mask).startswith("{\\p1}m 3.0 2.0")
    assert render.polygon(mask[:2]) == ""
    assert render.simplify([(0, 0), (5, 0), (10, 0)], 0.5) == [(0, 0), (10, 0)]
    assert render.simplify([(0, 0), (5, 4), (10, 0)], 0.5) == [(0, 0), (5, 4), (10, 0)]
