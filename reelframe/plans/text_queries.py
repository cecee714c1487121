"""Queries over text, times, artifacts and video metadata, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour, text
from ..operators import artifacts, video
from .bindings import EVENTS, PICTURES, STREAM, event_pictures, event_table, pixel_stream, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _clock(t: str, unit: int) -> str:
    return f"CAST(least(round(({t} - floor({t})) * {unit}), {unit - 1}) AS BIGINT)"


TIMES = """tm0 AS (SELECT event_id, (event_id * 7919 % 40000000) / 997.0::DOUBLE - 50 AS raw FROM events), tm AS (SELECT event_id, raw, greatest(raw, 0.0::DOUBLE) AS t FROM tm0)"""
_H, _M, _S = "CAST(floor(t / 3600) AS BIGINT)", "CAST(floor((t % 3600) / 60) AS BIGINT)", "CAST(floor(t) AS BIGINT) % 60"


@query(
    "tx_times",
    f"""WITH {TIMES} SELECT event_id, printf('%d:%02d:%02d.%02d', {_H}, {_M}, {_S}, {_clock("t", 100)}) AS ass,
    printf('%02d:%02d:%02d:%03d', {_H}, {_M}, {_S}, {_clock("t", 1000)}) AS vobsub, printf('%02d:%02d:%02d,%03d', {_H}, {_M}, {_S}, {_clock("t", 1000)}) AS srt FROM tm""",
)
def tx_times(spark, d):
    t = (F.col("event_id") * 7919 % 40000000) / F.lit(997.0) - 50
    return table(spark, d, "events").select("event_id", text.ass_time(t).alias("ass"), text.vobsub_time(t).alias("vobsub"), text.srt_time(t).alias("srt"))


@query("tx_shift_and_round", f"WITH {TIMES} SELECT event_id, round((raw + 15 * 0.01::DOUBLE) * 10000.0::DOUBLE) / 10000.0::DOUBLE AS four, round(raw * 100.0::DOUBLE) / 100.0::DOUBLE AS two FROM tm")
def tx_shift_and_round(spark, d):
    t = (F.col("event_id") * 7919 % 40000000) / F.lit(997.0) - 50
    return table(spark, d, "events").select("event_id", text.rounded(text.shifted(t, 15), 4).alias("four"), text.rounded(t, 2).alias("two"))


NAMES = """nm AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'subtitle_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.png' WHEN 1 THEN 'subtitle_' || event_id || '_top.JPG'
  WHEN 2 THEN 'subtitle_x' || event_id || '.json' WHEN 3 THEN 'other_' || event_id || '.ass' WHEN 4 THEN 'subtitle_' || event_id ELSE 'index.' || event_id || '.idx' END AS name FROM events)"""


def _names(spark, d):
    e = F.col("event_id").cast("string")
    kind = F.col("event_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("subtitle_"), F.format_string("%06d", "event_id"), F.lit(".png"))).when(kind == 1, F.concat(F.lit("subtitle_"), e, F.lit("_top.JPG")))
        .when(kind == 2, F.concat(F.lit("subtitle_x"), e, F.lit(".json"))).when(kind == 3, F.concat(F.lit("other_"), e, F.lit(".ass")))
        .when(kind == 4, F.concat(F.lit("subtitle_"), e)).otherwise(F.concat(F.lit("index."), e, F.lit(".idx")))
    )
    return table(spark, d, "events").select("event_id", name.alias("name"))


@query(
    "tx_names",
    f"""WITH {NAMES}, x AS (SELECT *, regexp_extract(name, '[^/]\\.([^./]+)$', 1) AS ext FROM nm) SELECT event_id,
    CASE WHEN event_id % 6 IN (0, 1, 4) THEN event_id END AS number,
    CASE ext WHEN 'png' THEN 'image/png' WHEN 'ass' THEN 'text/plain; charset=utf-8' WHEN 'idx' THEN 'text/plain; charset=utf-8' WHEN 'json' THEN 'application/json' ELSE 'application/octet-stream' END AS media,
    CASE lower(ext) WHEN 'jpg' THEN 'jpg' WHEN 'jpeg' THEN 'jpg' WHEN 'bmp' THEN 'bmp' ELSE 'png' END AS image FROM x""",
)
def tx_names(spark, d):
    name = F.col("name")
    ext = F.regexp_extract(name, r"[^/]\.([^./]+)$", 1)
    return _names(spark, d).select("event_id", text.image_number(name).alias("number"), text.media_type(name).alias("media"), text.image_extension(ext).alias("image"))


@query(
    "tx_levels",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ERROR' WHEN event_id % 5 = 1 THEN 'WARN' WHEN event_id % 5 = 2 THEN 'DEBUG' ELSE 'INFO' END AS level,
    CASE event_id % 5 WHEN 0 THEN 'nearest' WHEN 1 THEN 'triangle' WHEN 2 THEN 'catmullrom' WHEN 3 THEN 'gaussian' ELSE 'lanczos3' END AS filter FROM events""",
)
def tx_levels(spark, d):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.level(pick("ERROR", "WARN", "DEBUG", "info", "trace")).alias("level"), text.resize_filter(pick("Nearest", " bilinear", "bicubic", "gaussian", "?")).alias("filter"))


@query(
    "tx_parse_hex",
    f"""WITH {STREAM}, c AS (SELECT id, r, g, b, CASE WHEN id % 4 = 3 THEN '#12345' ELSE (CASE WHEN id % 4 = 0 THEN '#' ELSE '' END) || printf('%02x%02X%02x', r, g, b) END AS h FROM st)
    SELECT id, CASE WHEN id % 4 = 3 THEN 255 ELSE r END AS r, CASE WHEN id % 4 = 3 THEN 254 ELSE g END AS g, CASE WHEN id % 4 = 3 THEN 253 ELSE b END AS b FROM c""",
)
def tx_parse_hex(spark, d):
    code = F.concat(F.when(F.col("id") % 4 == 0, F.lit("#")).otherwise(F.lit("")), F.format_string("%02x%02X%02x", "r", "g", "b"))
    parsed = colour.parse_hex(F.when(F.col("id") % 4 == 3, F.lit("#12345")).otherwise(code), (255, 254, 253))
    return pixel_stream(spark, d).select("id", *[F.get(parsed, i).alias(c) for i, c in enumerate("rgb")])


@query("tx_base64", "SELECT doc_id, to_base64(encode(text)) AS b64, text AS back FROM documents")
def tx_base64(spark, d):
    code = text.base64_text(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", code.alias("b64"), F.decode(F.unbase64(code), "UTF-8").alias("back"))


@query(
    "tx_log_lines",
    """SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] [' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '] ' || props AS line FROM events""",
)
def tx_log_lines(spark, d):
    lvl = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.log_line(F.col("ts"), lvl, F.col("props")).alias("line"))


@query("src_log_tail", "SELECT user_id, event_id, k AS back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def src_log_tail(spark, d):
    return artifacts.tail(table(spark, d, "events"), 5, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "back")


@query("so_ring_dropped", "SELECT user_id, greatest(count(*) - 20, 0) AS dropped, least(count(*), 20) AS held FROM events GROUP BY user_id")
def so_ring_dropped(spark, d):
    return artifacts.ring(table(spark, d, "events"), 20, "user_id", ["ts", "event_id"])


@query(
    "so_first_pending",
    """SELECT user_id, min(event_id) FILTER (event_type = 'view') AS next_item, count(*) FILTER (event_type IN ('purchase', 'error')) = count(*) AS done FROM events GROUP BY user_id""",
)
def so_first_pending(spark, d):
    return video.batch_state(table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("item"), "event_type"), "event_type", "view", ["purchase", "error"]).withColumnRenamed("batch", "user_id")


RUNS = """ch AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS place, length(split_part(text, ' ', i)) % 4 AS c FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), LATERAL (SELECT unnest(range(1, len(string_split(text, ' ')) + 1)) AS i)),
rn AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY conv_id, turn ORDER BY place) = c THEN 0 ELSE 1 END AS new FROM ch),
rs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY place) AS run FROM rn),
rl AS (SELECT conv_id, turn, run::BIGINT AS run, any_value(c) AS c, min(place) AS first, count(*) AS length FROM rs GROUP BY conv_id, turn, run)"""


def _runs(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    words = turns.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "w"))
    places = words.select("conv_id", "turn", F.col("at").cast("long").alias("at"), (F.length("w") % 4).alias("c"))
    return artifacts.runs(places, ["conv_id", "turn"], "at", "c")


@query("wn_runs", f"WITH {RUNS} SELECT conv_id, turn, run, c, first, length FROM rl")
def wn_runs(spark, d):
    return _runs(spark, d)


@query(
    "sk_run_length_code",
    f"""WITH {RUNS}, l AS (SELECT *, length * (CASE WHEN run % 7 = 0 THEN 300 WHEN run % 5 = 0 THEN 40 ELSE 1 END) AS n FROM rl)
    SELECT conv_id, turn, string_agg(CASE WHEN n <= 15 THEN printf('%02x', n * 16 + c) WHEN n <= 255 THEN printf('%02x%02x', c, n) ELSE printf('%02x00%04x', c, n) END, '' ORDER BY run) AS code FROM l GROUP BY conv_id, turn""",
)
def sk_run_length_code(spark, d):
    n = F.col("length") * F.when(F.col("run") % 7 == 0, 300).when(F.col("run") % 5 == 0, 40).otherwise(1)
    coded = _runs(spark, d).select("conv_id", "turn", F.struct("run", artifacts.run_code(F.col("c"), n).alias("x")).alias("s"))
    joined = coded.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return joined.select("conv_id", "turn", F.array_join(F.transform("s", lambda x: x["x"]), "").alias("code"))


def _srt(t: str) -> str:
    g = f"greatest({t} + -20 * 0.01::DOUBLE, 0.0::DOUBLE)"
    return f"printf('%02d:%02d:%02d,%03d', CAST(floor({g} / 3600) AS BIGINT), CAST(floor(({g} % 3600) / 60) AS BIGINT), CAST(floor({g}) AS BIGINT) % 60, {_clock(g, 1000)})"


@query(
    "sk_srt",
    f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY position) AS k FROM ev WHERE NOT deleted)
    SELECT video_id, string_agg(k || chr(10) || {_srt("start")} || ' --> ' || {_srt('"end"')} || chr(10) || chr(10) || chr(10), '' ORDER BY k) AS content FROM n GROUP BY video_id""",
)
def sk_srt(spark, d):
    return artifacts.document(artifacts.srt_blocks(event_table(spark, d), -20))


def _moved(t: str) -> str:
    return f"({t} + -125 * 0.01::DOUBLE)"


@query(
    "sk_timeline",
    f"""WITH {EVENTS}, {PICTURES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY position) AS k FROM ep WHERE NOT deleted)
    SELECT video_id, k AS index, round({_moved("start")} * 10000) / 10000 AS start, round({_moved('"end"')} * 10000) / 10000 AS "end", start_frame, end_frame, concat_ws(',', bx, bt, bw, bh) AS bbox, '3,5' AS roi_origin,
    n AS diff_frames, count(*) OVER (PARTITION BY video_id) AS count, 1280 AS width, 720 AS height, -125 AS time_shift_10ms FROM n""",
)
def sk_timeline(spark, d):
    """Written with a time shift, and read back."""
    from ..sources import project

    found = project.read_timeline(artifacts.timeline(event_pictures(spark, d), -125, 1280, 720))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("bbox", "roi_origin")})


@query(
    "src_project_round_trip",
    f"""WITH {EVENTS}, {PICTURES} SELECT video_id, part, position, start, "end", start_frame, end_frame, n, CASE WHEN mask > 0 THEN printf('%02X', mask) END AS mask, 4 AS roi_w, 2 AS roi_h, '3,5' AS roi_origin,
    concat_ws(',', bx, bt, bw, bh) AS bbox, repeat(printf('%02X', position % 256), bw * bh * 3) AS image, end_frame AS source_frame, deleted
    FROM ep CROSS JOIN (SELECT unnest(['subtitles', 'filtered']) AS part) WHERE part = 'subtitles' OR deleted""",
)
def src_project_round_trip(spark, d):
    """Written with all rows, the deleted ones as filtered events too, and read back."""
    from ..sources import project

    e = event_pictures(spark, d)
    written = artifacts.project(e, e.filter("deleted"))
    subtitles, filtered = (project.read_events(written, part=part) for part in ("subtitles", "filtered"))
    order = W.partitionBy("video_id").orderBy("position")
    places = e.filter("deleted").select("video_id", (F.row_number().over(order) - 1).cast("long").alias("at"), F.col("position").alias("own"))
    filtered = filtered.withColumnRenamed("position", "at").join(places, ["video_id", "at"]).withColumn("position", F.col("own")).select(subtitles.columns)
    both = subtitles.withColumn("part", F.lit("subtitles")).unionByName(filtered.withColumn("part", F.lit("filtered")))
    listed = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("bbox", "roi_origin")}
    return both.withColumns(listed | {c: F.hex(c) for c in ("mask", "image")})


@query(
    "src_project_header",
    f"""WITH {EVENTS} SELECT video_id, video_id::VARCHAR AS video, 'v' || video_id || '.srt' AS srt, 9 AS gap_frames FROM ev GROUP BY video_id""",
)
def src_project_header(spark, d):
    """Video, artifacts and configuration of written projects, read back."""
    from ..config import Config, Rip
    from ..sources import project

    made = F.to_json(F.struct(F.concat(F.lit("v"), F.col("video_id"), F.lit(".srt")).alias("srt"), F.lit(None).cast("string").alias("ssa")))
    e = event_pictures(spark, d)
    files = e.select("video_id").distinct().withColumn("made", made)
    read = project.read_header(artifacts.project(e, config=Config(rip=Rip(gap_frames=9)).to_json(), artifacts=files))
    return read.select("video_id", "video", F.col("artifacts")["srt"].alias("srt"), F.get_json_object("config", "$.rip.gap_frames").cast("int").alias("gap_frames"))


@query(
    "sk_container_offsets",
    f"""WITH {EVENTS}, kp AS (SELECT video_id, position, p % 4 AS x, p // 4 AS y FROM ev CROSS JOIN (SELECT unnest(range(0, 8)) AS p) WHERE NOT deleted AND (mask >> (7 - p)) & 1 = 1),
    ci AS (SELECT *, x - row_number() OVER (PARTITION BY video_id, position ORDER BY x) AS part FROM (SELECT DISTINCT video_id, position, x FROM kp)),
    kk AS (SELECT * FROM (SELECT kp.*, count(*) OVER (PARTITION BY video_id, position, part) AS area FROM kp JOIN ci USING (video_id, position, x)) WHERE area > 4),
    rr AS (SELECT video_id, position, y, x - row_number() OVER (PARTITION BY video_id, position, y ORDER BY x) AS run FROM kk),
    rw AS (SELECT video_id, position, y, 4 + 2 * count(DISTINCT run) - 1 AS bytes FROM rr GROUP BY video_id, position, y),
    sz AS (SELECT ev.video_id, ev.position, 72 + coalesce(sum(bytes), 0) AS size FROM ev LEFT JOIN rw USING (video_id, position) WHERE NOT deleted GROUP BY ev.video_id, ev.position)
    SELECT video_id::VARCHAR AS video_id, row_number() OVER w AS number, coalesce(sum(size) OVER (PARTITION BY video_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM sz WINDOW w AS (PARTITION BY video_id ORDER BY position)""",
)
def sk_container_offsets(spark, d):
    """The offsets in the written index: a head, a palette, and a span of runs for each row with pixels, specks left out."""
    from ..config import Config
    from ..sources import writers

    made = writers.subpictures(event_pictures(spark, d), Config(), 640, 360).filter("name like '%.idx'")
    lines = made.select("video_id", F.posexplode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit("filepos: ([0-9a-f]{9})"))).alias("at", "code"))
    return lines.select("video_id", (F.col("at") + 1).alias("number"), F.conv("code", 16, 10).cast("bigint").alias("offset"))


@query(
    "sk_image_batches",
    f"""WITH {EVENTS}, {PICTURES}, g AS (SELECT video_id, position // 4 AS batch, count(*) AS tiles, 4 + sum(bw + 4)::BIGINT AS canvas_w, max(bh) AS canvas_h FROM ep WHERE NOT (position % 3 = 0 OR position BETWEEN 8 AND 11) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY batch) AS image FROM g""",
)
def sk_image_batches(spark, d):
    """Canvases of four positions each from the boxes of the events; some have no mask."""
    e = event_pictures(spark, d).filter("mask is not null").withColumns({"width": F.col("bbox")[2], "height": F.col("bbox")[3]})
    return artifacts.batches(e.withColumn("mask", F.when(~((F.col("position") % 3 == 0) | F.col("position").between(8, 11)), 1).otherwise(0)), 4)


BLANK = """rw AS (SELECT user_id AS image, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS y, event_id % 7 < 4 AS blank, count(*) OVER (PARTITION BY user_id) AS h FROM events),
rc AS (SELECT *, CASE WHEN lag(blank) OVER (PARTITION BY image ORDER BY y) = blank THEN 0 ELSE 1 END AS new FROM rw), rr AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY y) AS run FROM rc),
rg AS (SELECT image, run, min(y) AS first, count(*) AS n, any_value(h) AS h FROM rr WHERE blank GROUP BY image, run),
rk AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY image) AS total FROM rg)"""


@query("rn_blank_split", f"WITH {BLANK} SELECT image, (first * 2 + n - 1) // 2 AS split_y FROM rk WHERE k = 1 AND total >= 3 AND (first * 2 + n - 1) // 2 > h // 4 AND (first * 2 + n - 1) // 2 < h * 3 // 4")
def rn_blank_split(spark, d):
    per = W.partitionBy("user_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("image"), (F.row_number().over(per.orderBy("event_id")) - 1).cast("long").alias("y"), (F.col("event_id") % 7 < 4).alias("blank"), F.count("*").over(per).alias("h"))
    return artifacts.blank_split(rows)


VIDEOS = """vd AS (SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 1500)::DOUBLE END AS rate, CASE WHEN o_orderkey % 5 = 0 THEN -1.0::DOUBLE ELSE (o_orderkey % 7000) / 3.0::DOUBLE END AS container_s,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 12.5::DOUBLE END AS stream_s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 9 END AS frames, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % 1000 END AS pts FROM orders)"""


def _videos(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("video_id"), F.when(k % 3 != 0, (k % 1500).cast("double")).alias("rate"), F.when(k % 5 == 0, F.lit(-1.0)).otherwise((k % 7000) / 3.0).alias("container_s"),
        F.when(k % 7 != 0, F.lit(12.5)).alias("stream_s"), F.when(k % 4 != 0, k % 9).alias("frames"), F.when(k % 2 != 0, k % 1000).alias("pts"),
    )


@query(
    "src_video_defaults",
    f"""WITH {VIDEOS}, a AS (SELECT *, CASE WHEN rate BETWEEN 1 AND 1000 THEN rate ELSE 25.0 END AS fps, CASE WHEN container_s > 0 AND container_s < 100000 THEN container_s ELSE coalesce(stream_s, 0.0) END AS duration_s FROM vd)
    SELECT video_id, fps, duration_s, CASE WHEN frames > 0 THEN frames ELSE CAST(greatest(round(duration_s * fps), 0) AS BIGINT) END AS frame_count FROM a""",
)
def src_video_defaults(spark, d):
    return video.with_defaults(_videos(spark, d)).select("video_id", "fps", "duration_s", "frame_count")


@query(
    "src_frame_clock",
    f"""WITH {VIDEOS} SELECT video_id, coalesce(CAST(round(pts * 0.04::DOUBLE * 30.0::DOUBLE) AS BIGINT), video_id) AS idx, coalesce(pts * 0.04::DOUBLE, video_id / 25.0::DOUBLE) AS time FROM vd""",
)
def src_frame_clock(spark, d):
    idx, time = video.frame_clock(F.col("pts"), F.lit(0.04), F.lit(30.0), F.col("video_id"))
    return _videos(spark, d).select("video_id", idx.alias("idx"), time.alias("time"))


@query(
    "fl_frame_range",
    f"""WITH {VIDEOS}, a AS (SELECT video_id, CAST(round((video_id % 11) * 0.3::DOUBLE * 25.0) AS BIGINT) AS s, CASE WHEN video_id % 6 > 0 THEN CAST(round((video_id % 6) * 0.7::DOUBLE * 25.0) AS BIGINT) ELSE video_id % 90 END AS e, video_id % 90 AS total FROM vd)
    SELECT video_id, s AS first, least(greatest(e, s + 1), greatest(total, 1)) AS last FROM a""",
)
def fl_frame_range(spark, d):
    k = F.col("video_id")
    first, last = video.frame_range((k % 11) * 0.3, (k % 6) * 0.7, F.lit(25.0), k % 90)
    return _videos(spark, d).select("video_id", first.alias("first"), last.alias("last"))


@query("wn_progress", "SELECT user_id, k AS frames_done, k * 100 // n AS percent FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k % 12 = 0")
def wn_progress(spark, d):
    return video.progress(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 12.5)
