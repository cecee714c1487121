"""Queries over rendered pictures, scripts and settings, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config, Ocr, Output, Style
from ..operators import artifacts, packed, render
from .bindings import EVENTS, PICTURES, PIXELS, event_pictures, packed_frames, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _masked(spark, d):
    """Frames with the mask of their pixels whose red channel is above 130, and themselves as the region's image."""
    frames = packed_frames(spark, d)
    red = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.conv(F.hex(F.substring(F.col("rgb"), p * 3 + 1, 1)), 16, 10).cast("int") > 130)
    bits = F.array_join(F.transform(red, lambda on: F.when(on, F.lit("1")).otherwise(F.lit("0"))), "")
    return frames.select("video_id", "idx", F.unhex(F.lpad(F.conv(bits, 2, 16), 16, "0")).alias("mask"), F.lit(8).alias("roi_w"), F.lit(8).alias("roi_h"), F.col("rgb").alias("roi"))


# Bilinear samples at (i + (s + 1/2) / 2) / 1.5 - 1/2, held to the frame; their mean is the coverage, or the colour.
_AT = "least(greatest((t.i + (s.s + 0.5::DOUBLE) / 2) / 1.5::DOUBLE - 0.5, 0), 7)"
SAMPLES = f"""wt AS (SELECT t.i, s.s, CAST(floor({_AT}) AS BIGINT) AS a, least(CAST(floor({_AT}) AS BIGINT) + 1, 7) AS b, {_AT} - floor({_AT}) AS f FROM (SELECT unnest(range(0, 12)) AS i) t CROSS JOIN (SELECT unnest(range(0, 2)) AS s) s),
ax AS (SELECT i, s, a AS at, 1 - f AS w FROM wt UNION ALL SELECT i, s, b, f FROM wt),
sm AS (SELECT px.video_id, px.idx, y.i AS oy, x.i AS ox, sum(y.w * x.w * (px.r > 130)::INT) / 4 AS c, sum(y.w * x.w * px.r) / 4 AS r, sum(y.w * x.w * px.g) / 4 AS g, sum(y.w * x.w * px.b) / 4 AS b
  FROM px JOIN ax y ON y.at = px.y JOIN ax x ON x.at = px.x GROUP BY ALL),
gw AS (SELECT m.video_id, m.idx, m.oy, m.ox, round(max(n.c), 9) AS c, any_value(m.r) AS r, any_value(m.g) AS g, any_value(m.b) AS b FROM sm m JOIN sm n ON n.video_id = m.video_id AND n.idx = m.idx AND abs(n.oy - m.oy) <= 1 AND abs(n.ox - m.ox) <= 1 GROUP BY ALL)"""
TILE = Ocr(scale=1.5, supersample=2, stroke_dilate=1, coverage_gamma=1.0, despeckle_min_area=0, text_color="#0A141E", bg_color="#FAF0E6")


def _pixels(pictures):
    return packed.to_pixels(pictures).select("video_id", "idx", "pos", "r", "g", "b")


def _mixed(front: dict[str, str]) -> str:
    # Rounded to nine places first: both sides add the same numbers in different orders.
    back = {"r": 250, "g": 240, "b": 230}
    return ", ".join(f"CAST(floor(round(least(greatest({f} * c + {back[k]} * (1 - c), 0), 255), 9) + 0.5) AS BIGINT) AS {k}" for k, f in front.items())


@query("rn_tile", f"WITH {PIXELS}, {SAMPLES} SELECT video_id, idx, oy * 12 + ox AS pos, {_mixed({'r': '10', 'g': '20', 'b': '30'})} FROM gw")
def rn_tile(spark, d):
    return _pixels(render.pictures(_masked(spark, d).drop("roi"), TILE))


@query("rn_tile_colour", f"WITH {PIXELS}, {SAMPLES} SELECT video_id, idx, oy * 12 + ox AS pos, {_mixed({'r': 'r', 'g': 'g', 'b': 'b'})} FROM gw")
def rn_tile_colour(spark, d):
    """The region's own colours over the background, by the grown coverage."""
    return _pixels(render.pictures(_masked(spark, d), Ocr(**{**TILE.__dict__, "color_mode": "color"})))


@query("rn_tile_binary", f"WITH {PIXELS}, {SAMPLES} SELECT video_id, idx, oy * 12 + ox AS pos, CASE WHEN round(c, 9) >= 0.5 THEN 10 ELSE 250 END AS r, CASE WHEN round(c, 9) >= 0.5 THEN 20 ELSE 240 END AS g, CASE WHEN round(c, 9) >= 0.5 THEN 30 ELSE 230 END AS b FROM gw")
def rn_tile_binary(spark, d):
    return _pixels(render.pictures(_masked(spark, d), Ocr(**{**TILE.__dict__, "color_mode": "binary"})))


# 8 x 8 less a row above and two columns at the left is 6 x 7; two pixels around make 10 x 11, turned to 11 x 10, mirrored.
@query(
    "rn_canvas",
    f"""WITH {PIXELS}, gr AS (SELECT video_id, idx, unnest(range(0, 110)) AS p FROM px GROUP BY video_id, idx),
    pd AS (SELECT g.video_id, g.idx, g.p // 10 AS y, g.p % 10 AS x, coalesce(px.r, 250) AS r, coalesce(px.g, 240) AS g, coalesce(px.b, 230) AS b
      FROM gr g LEFT JOIN px ON px.video_id = g.video_id AND px.idx = g.idx AND g.p // 10 BETWEEN 2 AND 8 AND g.p % 10 BETWEEN 2 AND 7 AND px.y = g.p // 10 - 1 AND px.x = g.p % 10),
    tn AS (SELECT video_id, idx, x AS y, 10 - (10 - y) AS x, r, g, b FROM pd)
    SELECT video_id, idx, y * 11 + x AS pos, {", ".join(f"CAST(floor(least(greatest({c}::DOUBLE + 12, 0), 255) + 0.5) AS BIGINT) AS {c}" for c in "rgb")} FROM tn""",
)
def rn_canvas(spark, d):
    """Margins cut and padding added, then turned, mirrored and brightened."""
    ocr = Ocr(crop_top=1, crop_left=2, padding=2, rotate=90, flip_h=True, brightness=12, bg_color="#FAF0E6")
    return _pixels(render.edited(packed_frames(spark, d), ocr))


@query(
    "rn_halves",
    f"""WITH {PIXELS}, h AS (SELECT *, 1 + idx % 7 AS cut FROM px)
    SELECT video_id, idx, CASE WHEN y < cut THEN 'top' ELSE 'bottom' END AS half, CASE WHEN y < cut THEN y ELSE y - cut END * 8 + x AS pos, r, g, b FROM h""",
)
def rn_halves(spark, d):
    halves = render.split(packed_frames(spark, d).withColumn("split_y", 1 + F.col("idx") % 7))
    return packed.to_pixels(halves.withColumn("idx", F.struct("idx", "half"))).select("video_id", "idx.idx", "idx.half", "pos", "r", "g", "b")


@query("src_unpadded_rows", f"WITH {PIXELS} SELECT video_id, idx, pos, r, g, b FROM px")
def src_unpadded_rows(spark, d):
    """Rows that a decoder pads to 32 bytes, as frames of 24."""
    frames = packed_frames(spark, d)
    padded = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.concat(F.hex(F.substring(F.col("rgb"), y * 24 + 1, 24)), F.lit("AB" * 8)))
    frames = frames.withColumn("rgb", F.unhex(F.array_join(padded, "")))
    return _pixels(packed.unpadded(frames, F.lit(32)))


def _ass(t: str) -> str:
    g = f"greatest({t} + 50 * 0.01::DOUBLE, 0.0::DOUBLE)"
    hundredths = f"CAST(least(round(({g} - floor({g})) * 100), 99) AS BIGINT)"
    return f"printf('%d:%02d:%02d.%02d', CAST(floor({g} / 3600) AS BIGINT), CAST(floor(({g} % 3600) / 60) AS BIGINT), CAST(floor({g}) AS BIGINT) % 60, {hundredths})"


@query(
    "sk_script",
    f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY position) AS k FROM ev WHERE NOT deleted)
    SELECT video_id::VARCHAR AS video_id, k AS line, 'Dialogue: 0,' || {_ass("start")} || ', ' || {_ass('"end"')} || ',Default,,0,0,0,, ' AS text, 640 AS play_x, 360 AS play_y FROM n""",
)
def sk_script(spark, d):
    """The lines of the written vector scripts; masks of two rows have no outline, so that nothing is drawn."""
    from ..sources import writers

    made = writers.script(event_pictures(spark, d), Config(style=Style(time_shift_10ms=50)), 640, 360)
    text = made.select("video_id", F.decode("content", "UTF-8").alias("text"))
    size = lambda c: F.regexp_extract("text", rf"PlayRes{c}: (\d+)", 1).cast("int")
    lines = text.select("video_id", size("X").alias("play_x"), size("Y").alias("play_y"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(Dialogue: [^\n]*)\n"))).alias("at", "text"))
    return lines.select("video_id", (F.col("at") + 1).alias("line"), "text", "play_x", "play_y")


@query(
    "sk_bitmap_subtitles",
    f"""WITH {EVENTS}, {PICTURES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY position) AS k FROM ep WHERE NOT deleted)
    SELECT video_id::VARCHAR AS video_id, printf('%d_subs/%05d.bmp', video_id, k) AS name, bw + 8 AS width, bh AS height FROM n""",
)
def sk_bitmap_subtitles(spark, d):
    """Names and sizes of the pictures beside an SRT file: each tile between two gaps."""
    from ..sources import writers

    made = writers.bitmap_subtitles(event_pictures(spark, d), Config(output=Output(ocr=Ocr(despeckle_min_area=0))))
    number = lambda at: F.conv(F.hex(F.concat(*[F.substring("content", at + k, 1) for k in (3, 2, 1, 0)])), 16, 10).cast("bigint")
    return made.select("video_id", "name", number(19).alias("width"), number(23).alias("height"))


@query(
    "src_settings",
    """SELECT p_partkey, CASE WHEN p_size % 4 * 0.5 * greatest((p_partkey % 5) * 0.3::DOUBLE, 0.05) > 1e-6 THEN round(p_size % 4 * 0.5 * greatest((p_partkey % 5) * 0.3::DOUBLE, 0.05), 9) ELSE 1 END AS roi_scale, p_size AS gap_frames,
    concat_ws(',', CASE WHEN p_partkey % 3 > 0 THEN 'ssa' END, 'vobsub', 'ocr_png', CASE WHEN p_partkey % 3 < 2 THEN 'srt' END, 'json_timeline') AS kinds,
    CAST(round(p_size / 10.0 * 25) AS BIGINT) AS first_frame, least(greatest(CASE WHEN p_partkey % 2 = 0 THEN CAST(round(p_size / 5.0 * 25) AS BIGINT) ELSE 1000 END, CAST(round(p_size / 10.0 * 25) AS BIGINT) + 1), 1000) AS end_frame FROM part""",
)
def src_settings(spark, d):
    """What configuration documents say, missing keys at their defaults."""
    k, size = F.col("p_partkey"), F.col("p_size")
    outputs = F.when(k % 3 == 0, F.lit('"ssa":false')).when(k % 3 == 2, F.lit('"srt":false,"vobsub":true')).otherwise(F.lit('"unknown":1'))
    text = F.concat(
        F.lit('{"region":{"scale":'), (size % 4 * F.lit(0.5)).cast("double").cast("string"), F.lit('},"preview":{"scale_video":'), ((k % 5) * F.lit(0.3)).cast("string"), F.lit('},"rip":{"gap_frames":'), size.cast("string"),
        F.lit('},"start_seconds":'), (size / F.lit(10.0)).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(',"end_seconds":'), (size / F.lit(5.0)).cast("string"))).otherwise(F.lit("")),
        F.lit(',"output":{'), outputs, F.lit("}}"),
    )
    # The table is one small file; its rows are dealt to all tasks.
    parts = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    found = artifacts.settings(parts.select("p_partkey", text.alias("config")), "p_partkey", fps=25.0, frames=1000)
    return found.withColumn("roi_scale", F.round("roi_scale", 9))
