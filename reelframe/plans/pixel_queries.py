"""Queries over pixels and masks, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ColorSegment, Filter, Postprocess
from ..functions import colour
from ..operators import components, detect, diff, packed, pixel
from ..operators.masks import Bits
from .bindings import PIXELS, STREAM, packed_frames, pixel_stream, pixels

RGB = (F.col, "rgb")
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _rgb():
    return tuple(F.col(c) for c in "rgb")


HSV = """hsv0 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM st),
hsv1 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN r = mx THEN ((g - b) * 60) // d WHEN g = mx THEN ((b - r) * 60) // d + 120 ELSE ((r - g) * 60) // d + 240 END AS h0 FROM hsv0),
hsv AS (SELECT id, idx, r, g, b, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h, CASE WHEN mx = 0 THEN 0 ELSE d * 255 // mx END AS s, mx AS v FROM hsv1)"""


@query("px_hsv", f"WITH {STREAM}, {HSV} SELECT id, CAST(h AS BIGINT) AS h, CAST(s AS BIGINT) AS s, CAST(v AS BIGINT) AS v FROM hsv")
def px_hsv(spark, d):
    h, s, v = colour.hsv(*_rgb())
    return pixel_stream(spark, d).select("id", h.alias("h"), s.alias("s"), v.alias("v"))


@query(
    "px_yuv",
    f"""WITH {STREAM} SELECT id, CAST(least(greatest(trunc(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 0), 255) AS BIGINT) AS y,
    CAST(least(greatest(trunc(-0.169::DOUBLE * r - 0.331::DOUBLE * g + 0.5::DOUBLE * b + 128.0::DOUBLE), 0), 255) AS BIGINT) AS u,
    CAST(least(greatest(trunc(0.5::DOUBLE * r - 0.419::DOUBLE * g - 0.081::DOUBLE * b + 128.0::DOUBLE), 0), 255) AS BIGINT) AS v FROM st""",
)
def px_yuv(spark, d):
    y, u, v = colour.yuv(*_rgb())
    return pixel_stream(spark, d).select("id", y.alias("y"), u.alias("u"), v.alias("v"))


@query(
    "px_distances",
    f"""WITH {STREAM}, {HSV} SELECT id, CAST((r - 255) * (r - 255) + (g - 250) * (g - 250) + (b - 245) * (b - 245) AS BIGINT) AS squared,
    CAST(greatest(abs(r - 120), abs(g - 60), abs(b - 200)) AS BIGINT) AS chebyshev,
    CAST(least(abs(h // 2 - 40), 180 - abs(h // 2 - 40)) AS BIGINT) AS hue,
    CASE WHEN greatest(abs(r - 10), abs(g - 10), abs(b - 10)) < greatest(abs(r - 200), abs(g - 220), abs(b - 240)) THEN 2 ELSE 1 END AS class FROM hsv""",
)
def px_distances(spark, d):
    rgb = _rgb()
    return pixel_stream(spark, d).select(
        "id", colour.squared_distance(rgb, (255, 250, 245)).cast("long").alias("squared"), colour.chebyshev(rgb, (120, 60, 200)).cast("long").alias("chebyshev"),
        colour.hue_distance(colour.hsv(*rgb)[0], 220).cast("long").alias("hue"), colour.palette_class(rgb, (200, 220, 240), (10, 10, 10)).alias("class"),
    )


@query(
    "px_overlay",
    f"""WITH {STREAM} SELECT id, CASE WHEN r > 128 THEN r ELSE least(r * 2, 255) // 2 + 30 END AS r, CASE WHEN r > 128 THEN g ELSE least(g + 90, 255) END AS g,
    CASE WHEN r > 128 THEN b ELSE least(b * 2, 255) // 2 END AS b FROM st""",
)
def px_overlay(spark, d):
    r, g, b = colour.overlay(F.col("r") > 128, _rgb())
    return pixel_stream(spark, d).select("id", r.alias("r"), g.alias("g"), b.alias("b"))


_TONE = lambda c: f"least(greatest((259.0::DOUBLE * (76.5::DOUBLE + 255.0) / (255.0 * (259.0::DOUBLE - 76.5))) * ({c} - 128.0::DOUBLE) + 128.0::DOUBLE + 10.0::DOUBLE, 0.0::DOUBLE), 255.0::DOUBLE)"


@query(
    "rn_tone",
    f"""WITH {STREAM}, t AS (SELECT id, {_TONE("r")} AS r, {_TONE("g")} AS g, {_TONE("b")} AS b FROM st)
    SELECT id, CAST(round(r) AS BIGINT) AS r, CAST(round(g) AS BIGINT) AS g, CAST(round(b) AS BIGINT) AS b,
    CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS BIGINT) AS grey FROM t""",
)
def rn_tone(spark, d):
    r, g, b = colour.tone(_rgb(), 10, 30)
    grey = colour.tone(_rgb(), 10, 30, grey=True)[0]
    return pixel_stream(spark, d).select("id", r.alias("r"), g.alias("g"), b.alias("b"), grey.alias("grey"))


FULL = ColorSegment(hue=300, hue_diff=60, rgb=(120, 120, 120), rgb_diff=150, lum_min=60, lum_max=230, sat_min=20, sat_max=220, enable_hue=True, enable_lum_min=True, enable_lum_max=True, enable_sat_min=True, enable_sat_max=True)


@query(
    "fl_segment",
    f"""WITH {STREAM}, {HSV} SELECT id FROM hsv WHERE (r - 120) * (r - 120) + (g - 120) * (g - 120) + (b - 120) * (b - 120) <= 22500
    AND least(abs(h // 2 - 120), 180 - abs(h // 2 - 120)) <= 60 AND v BETWEEN 60 AND 230 AND s BETWEEN 20 AND 220""",
)
def fl_segment(spark, d):
    return pixel_stream(spark, d).filter(pixel.segment_hit(FULL, *_rgb())).select("id")


@query("fl_segment_without_checks", f"WITH {STREAM} SELECT count(*) AS n FROM st")
def fl_segment_without_checks(spark, d):
    return pixel_stream(spark, d).filter(pixel.segment_hit(ColorSegment(enable_rgb=False), *_rgb())).agg(F.count("*").alias("n"))


@query(
    "fl_filter",
    f"""WITH {STREAM} SELECT idx, count(*) AS n FROM st WHERE r * r + g * g + b * b <= 900
    OR (r - 255) * (r - 255) + (g - 255) * (g - 255) + (b - 255) * (b - 255) <= 1600 GROUP BY idx""",
)
def fl_filter(spark, d):
    return pixel_stream(spark, d).filter(pixel.filter_hit(Filter(), *_rgb())).groupBy("idx").agg(F.count("*").alias("n"))


@query(
    "fl_filter_pass1",
    f"WITH {STREAM} SELECT idx, count(*) AS n FROM st WHERE (r - 200) * (r - 200) + (g - 200) * (g - 200) + (b - 200) * (b - 200) <= 10000 GROUP BY idx",
)
def fl_filter_pass1(spark, d):
    cfg = Filter(method="other", segments={"pass1": ColorSegment(rgb=(200, 200, 200), rgb_diff=100), "final": ColorSegment(enable_rgb=False)})
    return pixel_stream(spark, d).filter(pixel.filter_hit(cfg, *_rgb())).groupBy("idx").agg(F.count("*").alias("n"))


@query(
    "ag_frame_stats",
    f"""WITH {PIXELS}, u AS (SELECT video_id, idx, unnest([r, g, b]) AS v FROM px)
    SELECT video_id, idx, count(*) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high FROM u GROUP BY video_id, idx""",
)
def ag_frame_stats(spark, d):
    return pixel.frame_stats(pixels(spark, d))


@query("px_crop", f"WITH {PIXELS} SELECT video_id, idx, (y - 1) * 5 + x - 2 AS pos, x - 2 AS x, y - 1 AS y, r, g, b FROM px WHERE y >= 1 AND y < 6 AND x >= 2 AND x < 7")
def px_crop(spark, d):
    return pixel.crop(pixels(spark, d), 8, 8, up=1, down=2, left=2, right=1).select("video_id", "idx", "pos", "x", "y", "r", "g", "b")


@query("px_crop_too_far", f"WITH {PIXELS} SELECT video_id, idx, count(*) FILTER (y >= 6 AND x >= 7) AS kept, 0 AS none FROM px GROUP BY video_id, idx")
def px_crop_too_far(spark, d):
    """Margins beyond the frame are held to it: beside the corner that one crop keeps, the other keeps nothing."""
    p = pixels(spark, d)
    left = lambda name, **margins: pixel.crop(p, 8, 8, **margins).groupBy("video_id", "idx").agg(F.count("*").alias(name))
    kept = p.select("video_id", "idx").distinct().join(left("kept", up=6, left=7, down=-3), ["video_id", "idx"], "left").join(left("none", up=6, down=20), ["video_id", "idx"], "left")
    return kept.na.fill(0)


@query(
    "px_scale_nearest",
    f"""WITH {PIXELS}, t AS (SELECT unnest(range(0, 12)) AS t), g AS (SELECT a.t AS x, b.t AS y, CAST(trunc(least(a.t / 1.5::DOUBLE, 7)) AS BIGINT) AS sx, CAST(trunc(least(b.t / 1.5::DOUBLE, 7)) AS BIGINT) AS sy FROM t a CROSS JOIN t b)
    SELECT video_id, idx, g.y * 12 + g.x AS pos, r, px.g, b FROM g JOIN px ON px.x = g.sx AND px.y = g.sy""",
)
def px_scale_nearest(spark, d):
    return pixel.scale_nearest(pixels(spark, d), 8, 8, 1.5).select("video_id", "idx", "pos", "r", "g", "b")


@query(
    "px_scale_down",
    f"WITH {PIXELS} SELECT video_id, idx, (y // 2) * 4 + x // 2 AS pos, r, g, b FROM px WHERE x % 2 = 0 AND y % 2 = 0",
)
def px_scale_down(spark, d):
    return pixel.scale_nearest(pixels(spark, d), 8, 8, 0.5).select("video_id", "idx", "pos", "r", "g", "b")


@query(
    "px_sharpen",
    f"""WITH {PIXELS}, n AS (SELECT *, {", ".join(f"(lag({c}) OVER ys + lead({c}) OVER ys + lag({c}) OVER xs + lead({c}) OVER xs) // 4 AS m{c}" for c in "rgb")}
      FROM px WINDOW ys AS (PARTITION BY idx, x ORDER BY y), xs AS (PARTITION BY idx, y ORDER BY x))
    SELECT video_id, idx, pos, {", ".join(f"CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN least(greatest({c} + (({c} - m{c}) * 3) // 5, 0), 255) ELSE {c} END AS {c}" for c in "rgb")} FROM n""",
)
def px_sharpen(spark, d):
    return pixel.sharpen(pixels(spark, d), 8, 8).select("video_id", "idx", "pos", "r", "g", "b")


@query(
    "rn_rotate",
    f"""WITH {PIXELS} SELECT idx, pos, x * 8 + (7 - y) AS cw, (7 - x) * 8 + y AS ccw, (7 - y) * 8 + 7 - x AS half, y * 8 + 7 - x AS flip_h, (7 - y) * 8 + x AS flip_v FROM px""",
)
def rn_rotate(spark, d):
    x, y = F.col("x"), F.col("y")
    turned = {"cw": "cw", "ccw": "ccw", "half": "180", "flip_h": "flip_h", "flip_v": "flip_v"}
    at = {name: pixel.rotate(x, y, 8, 8, how) for name, how in turned.items()}
    return pixels(spark, d).select("idx", "pos", *[(ty * 8 + tx).alias(name) for name, (tx, ty) in at.items()])


@query(
    "px_preview_combo",
    f"""WITH {PIXELS} SELECT video_id, idx, x, y, r, g, b FROM px UNION ALL
    SELECT video_id, idx, x + 8, y, CASE WHEN v > 0.1 THEN r ELSE least(r * 2, 255) // 2 + 30 END, CASE WHEN v > 0.1 THEN g ELSE least(g + 90, 255) END, CASE WHEN v > 0.1 THEN b ELSE least(b * 2, 255) // 2 END FROM px""",
)
def px_preview_combo(spark, d):
    p = pixels(spark, d)
    return pixel.compose(p, p.filter("v > 0.1D"), "combo", 8)


@query("px_preview_mask", f"WITH {PIXELS} SELECT video_id, idx, x, y, CAST(CASE WHEN v > 0.1 THEN 255 ELSE 0 END AS BIGINT) AS r FROM px")
def px_preview_mask(spark, d):
    p = pixels(spark, d)
    return pixel.compose(p, p.filter("v > 0.1D"), "mask", 8).select("video_id", "idx", "x", "y", "r")


@query(
    "px_remap",
    f"WITH {PIXELS} SELECT idx, pos, least(greatest(CAST(round(x / 0.75::DOUBLE) AS BIGINT) + 3, 0), 11) AS fx, least(greatest(CAST(round(y / 0.75::DOUBLE) AS BIGINT) - 2, 0), 7) AS fy FROM px",
)
def px_remap(spark, d):
    fx, fy = pixel.remap(F.col("x"), F.col("y"), 0.75, (3, -2), 12, 8)
    return pixels(spark, d).select("idx", "pos", fx.alias("fx"), fy.alias("fy"))


@query("src_pick_pixel", f"WITH {PIXELS} SELECT video_id, idx, r, g, b FROM px WHERE x = least(greatest(idx % 12 - 2, 0), 7) AND y = 7")
def src_pick_pixel(spark, d):
    return pixel.pick(pixels(spark, d), F.col("idx") % 12 - 2, F.lit(99), 8, 8).select("video_id", "idx", "r", "g", "b")


@query("src_sample_range", f"WITH {PIXELS} SELECT DISTINCT video_id, idx FROM px WHERE idx >= 10 AND (idx - 10) % 3 = 0")
def src_sample_range(spark, d):
    return diff.sample(pixels(spark, d).select("video_id", "idx"), 10, step=3).distinct()


DILATED = """hit AS (SELECT video_id, idx, x, y FROM px WHERE v > 0.1), o AS (SELECT unnest([-1, 0, 1]) AS o),
dil AS (SELECT DISTINCT video_id, idx, (y + b.o) * 8 + x + a.o AS pos FROM hit CROSS JOIN o a CROSS JOIN o b WHERE x + a.o BETWEEN 0 AND 7 AND y + b.o BETWEEN 0 AND 7)"""


@query("st_dilate", f"WITH {PIXELS}, {DILATED} SELECT video_id, idx, pos FROM dil")
def st_dilate(spark, d):
    return pixel.dilate(pixels(spark, d).filter("v > 0.1D"), 8, 8)


DIFFED = """pair AS (SELECT video_id, idx, lag(idx) OVER (PARTITION BY video_id ORDER BY idx) AS prev FROM (SELECT DISTINCT video_id, idx FROM px)),
chg AS (SELECT a.video_id, a.idx, a.pos, a.r, a.g, a.b, greatest(abs(a.r - p.r), abs(a.g - p.g), abs(a.b - p.b)) > 24 AS changed
  FROM px a JOIN pair USING (video_id, idx) JOIN px p ON p.video_id = a.video_id AND p.idx = pair.prev AND p.pos = a.pos)"""


@query("jn_frame_diff", f"WITH {PIXELS}, {DIFFED} SELECT video_id, idx, count(*) FILTER (changed) AS changed, count(*) AS n, count(*) FILTER (changed) / count(*)::DOUBLE AS ratio FROM chg GROUP BY video_id, idx")
def jn_frame_diff(spark, d):
    return diff.change_counts(diff.pixel_changes(pixels(spark, d)))


@query("jn_packed_diff", ORACLES["jn_frame_diff"])
def jn_packed_diff(spark, d):
    return packed.frame_differences(packed_frames(spark, d)).select("video_id", "idx", "changed", "n", "ratio")


@query("fl_change_frames", f"WITH {PIXELS}, {DIFFED} SELECT video_id, idx, count(*) FILTER (changed) AS changed FROM chg GROUP BY video_id, idx HAVING count(*) FILTER (changed) >= 50 AND count(*) FILTER (changed) / count(*)::DOUBLE * 100 >= 80")
def fl_change_frames(spark, d):
    return diff.change_frames(diff.pixel_changes(pixels(spark, d)), 50, 80.0).select("video_id", "idx", "changed")


MASKS = """m AS (SELECT video_id, idx, bit_or(CASE WHEN v > {t} THEN 1::UBIGINT << pos ELSE 0::UBIGINT END) AS mask FROM px GROUP BY video_id, idx)"""


def frame_masks(spark, d, above: float):
    hit = F.col("v") > F.lit(above)
    bits = Bits.collect(F.when(hit, F.col("pos")))
    return pixels(spark, d).groupBy("video_id", "idx").agg(F.coalesce(bits, F.lit(0).cast("long")).alias("mask"))


@query(
    "jn_mask_iou",
    f"""WITH {PIXELS}, {MASKS.format(t=-0.15)}, l AS (SELECT *, lag(mask) OVER (PARTITION BY video_id ORDER BY idx) AS before FROM m)
    SELECT video_id, idx, CASE WHEN bit_count(mask | before) = 0 THEN 0.0 ELSE bit_count(mask & before) / bit_count(mask | before)::DOUBLE END AS iou FROM l WHERE before IS NOT NULL""",
)
def jn_mask_iou(spark, d):
    from pyspark.sql import Window as W

    m = frame_masks(spark, d, -0.15).withColumn("before", F.lag("mask").over(W.partitionBy("video_id").orderBy("idx")))
    return m.filter("before is not null").select("video_id", "idx", Bits.iou(F.col("before"), F.col("mask")).alias("iou"))


LABELLED = """cc AS (WITH RECURSIVE s AS (SELECT video_id, idx, x, y, pos FROM px WHERE v > 0.1),
 w(idx, pos, root) AS (SELECT idx, pos, pos FROM s UNION SELECT n.idx, n.pos, w.root FROM w JOIN s c ON c.idx = w.idx AND c.pos = w.pos
   JOIN s n ON n.idx = c.idx AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1)
 SELECT s.video_id, s.idx, s.pos, s.x, s.y, min(w.root) AS comp FROM w JOIN s ON s.idx = w.idx AND s.pos = w.pos GROUP BY ALL),
cs AS (SELECT video_id, idx, comp, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cc GROUP BY video_id, idx, comp)"""


def _hits(spark, d):
    return pixels(spark, d).filter("v > 0.1D").select("video_id", "idx", "pos")


@query("cc_label", f"WITH {PIXELS}, {LABELLED} SELECT video_id, idx, pos, comp FROM cc")
def cc_label(spark, d):
    return components.label(_hits(spark, d), 8)


@query("cc_stats", f"WITH {PIXELS}, {LABELLED} SELECT * FROM cs")
def cc_stats(spark, d):
    return components.stats(components.label(_hits(spark, d), 8), 8)


@query(
    "cc_clean",
    f"""WITH {PIXELS}, {LABELLED} SELECT cc.video_id, cc.idx, cc.pos FROM cc JOIN cs USING (idx, comp)
    WHERE NOT (area = 1 OR (area <= 4 AND (max_x = min_x OR max_y = min_y)) OR (min_y < 3 AND max_y > 4))""",
)
def cc_clean(spark, d):
    return components.clean(_hits(spark, d), Postprocess(), 8, 8)


@query("cc_clean_strict", f"WITH {PIXELS}, {LABELLED} SELECT cc.video_id, cc.idx, cc.pos FROM cc JOIN cs USING (idx, comp) WHERE NOT (area > 5 OR min_x = 0 OR min_y = 0 OR max_x = 7 OR max_y = 7)")
def cc_clean_strict(spark, d):
    cfg = Postprocess(single_dot=False, single_line=False, pass_center=False, large_block=5, touch_edge=True)
    return components.clean(_hits(spark, d), cfg, 8, 8)


@query("cc_despeckle", f"WITH {PIXELS}, {LABELLED} SELECT cc.video_id, cc.idx, cc.pos FROM cc JOIN cs USING (idx, comp) WHERE area > 4")
def cc_despeckle(spark, d):
    return components.despeckle(_hits(spark, d), 8, 4)


@query(
    "cc_bounding_box",
    f"""WITH {PIXELS} SELECT video_id, idx, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS area, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh
    FROM px WHERE v > 0.1 GROUP BY video_id, idx""",
)
def cc_bounding_box(spark, d):
    return pixel.bounding_box(_hits(spark, d), 8)


@query(
    "cc_crop_to_box",
    f"""WITH {PIXELS}, h AS (SELECT * FROM px WHERE v > 0.1), bb AS (SELECT idx, min(x) AS mx, min(y) AS my, max(x) - min(x) + 1 AS bw FROM h GROUP BY idx)
    SELECT video_id, idx, (y - my) * bw + x - mx AS pos FROM h JOIN bb USING (idx)""",
)
def cc_crop_to_box(spark, d):
    return pixel.crop_to_box(_hits(spark, d), 8)


@query("wn_row_extents", f"WITH {PIXELS} SELECT video_id, idx, y, min(x) AS first_x, max(x) AS last_x FROM px WHERE v > 0.1 GROUP BY video_id, idx, y")
def wn_row_extents(spark, d):
    return pixel.row_extents(_hits(spark, d), 8)


COLOURS = """rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY r + g + b, pos) - 1 AS k, count(*) OVER (PARTITION BY video_id, idx) AS n FROM chg WHERE changed),
au AS (SELECT video_id, idx, any_value(n) AS n, {cols} FROM rk GROUP BY video_id, idx)""".format(
    cols=", ".join(
        f"CASE WHEN any_value(n) < 16 THEN {d} ELSE list_sort(list({c}) FILTER ({w}))[count(*) FILTER ({w}) // 2 + 1] END AS {name}_{c}"
        for name, w, d in (("main", "k >= n * 85 // 100", 255), ("outline", "k < greatest(n * 15 // 100, 1)", 0))
        for c in "rgb"
    )
)


@query("ag_auto_colours", f"WITH {PIXELS}, {DIFFED}, {COLOURS} SELECT * FROM au")
def ag_auto_colours(spark, d):
    return detect.auto_colours(diff.pixel_changes(pixels(spark, d)).filter("changed"))


@query(
    "wn_tuned_frame",
    f"""WITH {PIXELS}, {DIFFED}, {COLOURS}, t AS (SELECT au.*, (SELECT count(*) FROM px WHERE px.idx = au.idx AND v > 0.15) AS c FROM au),
    q AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k FROM t WHERE (main_r + main_g + main_b) / 3.0 >= 155 AND (outline_r + outline_g + outline_b) / 3.0 <= 95 AND c > 0 AND c / 64.0 < 0.3)
    SELECT video_id, idx AS tuned_idx, main_r, main_g, main_b, outline_r, outline_g, outline_b FROM q WHERE k = 1""",
)
def wn_tuned_frame(spark, d):
    p = pixels(spark, d)
    counts = p.groupBy("video_id", "idx").agg(F.count_if(F.col("v") > 0.15).alias("mask_count"), F.lit(64).alias("area"))
    return detect.tuned_frame(detect.auto_colours(diff.pixel_changes(p).filter("changed")).join(counts, ["video_id", "idx"]))


CANDIDATE_ROWS = """mm AS (SELECT video_id, idx, bit_or(CASE WHEN v > 0.25 THEN 1::UBIGINT << pos ELSE 0::UBIGINT END) AS mask FROM px GROUP BY video_id, idx),
ch AS (SELECT video_id, idx, bit_or(CASE WHEN changed THEN 1::UBIGINT << pos ELSE 0::UBIGINT END) AS change_mask, count(*) FILTER (changed) AS c FROM chg GROUP BY video_id, idx),
cr AS (SELECT video_id, idx, mask, change_mask, coalesce(lag(mask) OVER (PARTITION BY video_id ORDER BY idx), 0::UBIGINT) AS before FROM ch JOIN mm USING (video_id, idx) WHERE c >= 20 AND c / 64.0 * 100 >= 0.5),
ck AS (SELECT *, CASE WHEN mask <> 0 AND (before = 0 OR bit_count(mask & before) / bit_count(mask | before)::DOUBLE < 0.7) THEN 'candidate'
  WHEN mask = 0 AND before <> 0 THEN 'close' WHEN mask = 0 AND change_mask <> 0 THEN 'filtered' END AS kind FROM cr)"""


def change_rows(spark, d):
    """Change frames with the mask of bright pixels and the mask of changed ones."""
    p = pixels(spark, d)
    changes = diff.pixel_changes(p)
    bits = lambda c: F.coalesce(Bits.collect(F.when(c, F.col("pos"))), F.lit(0).cast("long"))
    per = changes.groupBy("video_id", "idx").agg(bits(F.col("changed")).alias("change_mask"), F.count_if("changed").alias("changed"), F.count("*").alias("n"))
    per = per.filter(diff.is_change(F.col("changed"), F.col("changed") / F.col("n")))
    return per.join(frame_masks(spark, d, 0.25), ["video_id", "idx"]).select("video_id", "idx", "mask", "change_mask")


@query("wn_candidates", f"WITH {PIXELS}, {DIFFED}, {CANDIDATE_ROWS} SELECT video_id, idx, kind, bit_count(CASE WHEN kind = 'filtered' THEN change_mask ELSE mask END)::BIGINT AS size FROM ck WHERE kind IS NOT NULL")
def wn_candidates(spark, d):
    found = detect.candidates(change_rows(spark, d))
    return found.select("video_id", "idx", "kind", F.bit_count("mask").cast("long").alias("size"))
