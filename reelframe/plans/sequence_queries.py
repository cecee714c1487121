"""Queries over candidates, events and manager tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config, Ocr, Region
from ..operators import artifacts, detect, manager
from ..operators.rip import changes, probe, tuned
from ..operators.rip import rip as rip_frames
from ..operators.segment import merge_repeats, segment
from .bindings import CANDIDATES, EVENTS, PICTURES, candidate_stream, event_pictures, event_table, packed_frames, table
from .pixel_queries import CANDIDATE_ROWS, COLOURS, DIFFED, PIXELS, change_rows

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


# A row-by-row reading of the segmentation rule: no = number of the open event (0: none open since the last close).
FOLD = """so AS (SELECT video_id, idx, time, mask, close_only, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k FROM {rows}),
f(video_id, k, idx, no, opened, u, last) AS (
 SELECT video_id, k, idx, CASE WHEN close_only THEN 0 ELSE 1 END, NOT close_only, CASE WHEN close_only THEN {zero} ELSE mask END, idx FROM so WHERE k = 1
 UNION ALL
 SELECT s.video_id, s.k, s.idx, CASE WHEN s.close_only OR NOT n.fresh THEN f.no ELSE f.no + 1 END, NOT s.close_only,
  CASE WHEN s.close_only THEN {zero} WHEN n.fresh THEN s.mask ELSE f.u | s.mask END, CASE WHEN s.close_only THEN f.last ELSE s.idx END
 FROM f JOIN so s ON s.video_id = f.video_id AND s.k = f.k + 1, LATERAL (SELECT NOT f.opened
  OR NOT (CASE WHEN bit_count(f.u | s.mask) = 0 THEN 0 ELSE bit_count(f.u & s.mask) / bit_count(f.u | s.mask)::DOUBLE END >= 0.7 OR s.idx - f.last <= 5) AS fresh) n),
fo AS (SELECT f.video_id, f.k, f.idx, f.no, s.time, s.mask, s.close_only, lag(f.opened, 1, false) OVER (PARTITION BY f.video_id ORDER BY f.k) AS was_open FROM f JOIN so s USING (video_id, k)),
se AS (SELECT video_id, no AS event_no, min(time) FILTER (NOT close_only) AS start,
  coalesce(min(time) FILTER (close_only AND was_open), max(time) FILTER (NOT close_only) + 1.0::DOUBLE / 25.0) AS "end",
  min(idx) FILTER (NOT close_only) AS start_frame, coalesce(min(idx) FILTER (close_only AND was_open), max(idx) FILTER (NOT close_only)) AS end_frame,
  count(*) FILTER (NOT close_only) AS n, bit_or(mask) FILTER (NOT close_only) AS mask, max(idx) FILTER (NOT close_only) AS source_frame
  FROM fo WHERE no > 0 GROUP BY video_id, no)"""
B3 = f"WITH RECURSIVE {CANDIDATES}, {FOLD.format(rows='cd', zero='0')}"


@query("wn_segment", f"{B3} SELECT * FROM se")
def wn_segment(spark, d):
    return segment(candidate_stream(spark, d))


MERGE = """me AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS k FROM {rows}),
mf(video_id, k, g, u, last) AS (SELECT video_id, k, 1, mask, "end" FROM me WHERE k = 1
 UNION ALL SELECT e.video_id, e.k, CASE WHEN j.same THEN f.g ELSE f.g + 1 END, CASE WHEN j.same THEN f.u | e.mask ELSE e.mask END, e."end"
 FROM mf f JOIN me e ON e.video_id = f.video_id AND e.k = f.k + 1,
 LATERAL (SELECT {force} OR (CASE WHEN bit_count(f.u | e.mask) = 0 THEN 0 ELSE bit_count(f.u & e.mask) / bit_count(f.u | e.mask)::DOUBLE END >= 0.9 AND e.start - f.last <= {gap}) AS same) j)"""


@query(
    "wn_merge_repeats",
    f"""{B3}, {MERGE.format(rows="se", order="event_no", force="false", gap="0.5::DOUBLE")}
    SELECT video_id, g AS event_no, arg_min(start, k) AS start, arg_max("end", k) AS "end", arg_min(start_frame, k) AS start_frame, arg_max(end_frame, k) AS end_frame,
    sum(n)::BIGINT AS n, bit_or(mask) AS mask, arg_max(source_frame, k) AS source_frame FROM mf JOIN me USING (video_id, k) GROUP BY video_id, g""",
)
def wn_merge_repeats(spark, d):
    return merge_repeats(segment(candidate_stream(spark, d)), 0.5)


@query(
    "wn_force_merge",
    f"""{B3} SELECT video_id, 1 AS event_no, arg_min(start, event_no) AS start, arg_max("end", event_no) AS "end", arg_min(start_frame, event_no) AS start_frame,
    arg_max(end_frame, event_no) AS end_frame, sum(n)::BIGINT AS n, bit_or(mask) AS mask, arg_max(source_frame, event_no) AS source_frame FROM se GROUP BY video_id""",
)
def wn_force_merge(spark, d):
    return merge_repeats(segment(candidate_stream(spark, d)), 0.0, force=True)


@query("ag_rip_totals", f'{B3} SELECT count(*) AS events, sum(n)::BIGINT AS candidates, count(DISTINCT video_id) AS videos, round(sum("end" - start), 4) AS seconds FROM se')
def ag_rip_totals(spark, d):
    s = segment(candidate_stream(spark, d))
    return s.agg(F.count("*").alias("events"), F.sum("n").alias("candidates"), F.countDistinct("video_id").alias("videos"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


def rip(spark, d):
    """Frame differences to merged events over the embeddings' frames."""
    found = detect.candidates(change_rows(spark, d)).filter("kind <> 'filtered'")
    rows = found.select("video_id", "idx", (F.col("idx") / 25.0).alias("time"), "mask", (F.col("kind") == "close").alias("close_only"))
    return merge_repeats(segment(rows), 2.0 / 25.0)


RIP = f"""WITH RECURSIVE {PIXELS}, {DIFFED}, {CANDIDATE_ROWS},
rr AS (SELECT video_id, idx, idx / 25.0::DOUBLE AS time, mask, kind = 'close' AS close_only FROM ck WHERE kind IN ('candidate', 'close')),
{FOLD.format(rows="rr", zero="0::UBIGINT")}, {MERGE.format(rows="se", order="event_no", force="false", gap="0.08::DOUBLE")}"""


@query(
    "rip_events",
    f"""{RIP} SELECT video_id, g AS event_no, arg_min(start, k) AS start, arg_max("end", k) AS "end", arg_min(start_frame, k) AS start_frame, arg_max(end_frame, k) AS end_frame,
    sum(n)::BIGINT AS n, bit_or(mask)::HUGEINT::VARCHAR AS mask, arg_max(source_frame, k) AS source_frame FROM mf JOIN me USING (video_id, k) GROUP BY video_id, g""",
)
def rip_events(spark, d):
    unsigned = F.conv(F.hex("mask"), 16, 10)
    return rip(spark, d).withColumn("mask", unsigned).select("video_id", "event_no", "start", "end", "start_frame", "end_frame", "n", "mask", "source_frame")


#: The rip's configuration over the 8 x 8 frames: margins that leave 7 x 7, sharpened; all other values are the defaults.
RIP_CONFIG = Config(region=Region(up=1, left=1, sharpen=True))


def _cleaned(name: str, rows: str, side: int = 7) -> str:
    """CTEs up to `name` (video_id, idx, pos): filter by the colours in rows, dilated once and cleaned up."""
    above, below = int(side * 0.38), int(side * 0.62)
    near = lambda w, d: " + ".join(f"(px.{c} - w.{w}_{c}) * (px.{c} - w.{w}_{c})" for c in "rgb") + f" <= {d * d}"
    return f"""{name}_h AS (SELECT DISTINCT w.video_id, w.idx, px.x + a.o AS x, px.y + b.o AS y FROM {rows} w JOIN px USING (video_id, idx) CROSS JOIN o a CROSS JOIN o b
  WHERE ({near("main", 40)} OR {near("outline", 30)}) AND px.x + a.o BETWEEN 0 AND {side - 1} AND px.y + b.o BETWEEN 0 AND {side - 1}),
{name}_c AS (WITH RECURSIVE s AS (SELECT *, y * {side} + x AS pos FROM {name}_h),
 w(idx, pos, root) AS (SELECT idx, pos, pos FROM s UNION SELECT n.idx, n.pos, w.root FROM w JOIN s c ON c.idx = w.idx AND c.pos = w.pos JOIN s n ON n.idx = c.idx AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1)
 SELECT s.video_id, s.idx, s.pos, s.x, s.y, min(w.root) AS comp FROM w JOIN s ON s.idx = w.idx AND s.pos = w.pos GROUP BY ALL),
{name}_s AS (SELECT idx, comp FROM {name}_c GROUP BY idx, comp HAVING NOT (count(*) = 1 OR (count(*) <= 4 AND (max(x) = min(x) OR max(y) = min(y))) OR (min(y) < {above} AND max(y) > {below}))),
{name} AS (SELECT c.video_id, c.idx, c.pos FROM {name}_c c JOIN {name}_s USING (idx, comp))"""


# Region, differences, colours of changed pixels, tuned colours, masks of 49 bits from bit 55 down, candidates.
REGION = ", ".join(f"CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 5 THEN least(greatest({c} + (({c} - m{c}) * 3) // 5, 0), 255) ELSE {c} END AS {c}" for c in "rgb")
AROUND = ", ".join(f"(lag({c}) OVER ys + lead({c}) OVER ys + lag({c}) OVER xs + lead({c}) OVER xs) // 4 AS m{c}" for c in "rgb")
NAMES = [f"{w}_{c}" for w in ("main", "outline") for c in "rgb"]
TUNED = f"""{PIXELS.replace("px AS", "p8 AS")},
rg AS (SELECT video_id, idx, (y - 1) * 7 + x - 1 AS pos, x - 1 AS x, y - 1 AS y, r, g, b FROM p8 WHERE x >= 1 AND y >= 1),
ar AS (SELECT *, {AROUND} FROM rg WINDOW ys AS (PARTITION BY idx, x ORDER BY y), xs AS (PARTITION BY idx, y ORDER BY x)),
px AS (SELECT video_id, idx, pos, x, y, {REGION} FROM ar), o AS (SELECT unnest([-1, 0, 1]) AS o), {DIFFED}, {COLOURS},
ch AS (SELECT video_id, idx, bit_or(CASE WHEN changed THEN 1::UBIGINT << (55 - pos) ELSE 0::UBIGINT END) AS change_mask FROM chg GROUP BY video_id, idx
  HAVING count(*) FILTER (changed) >= 20 AND count(*) FILTER (changed) / count(*)::DOUBLE * 100 >= 0.5),
pl AS (SELECT au.* FROM au JOIN ch USING (video_id, idx) WHERE (main_r + main_g + main_b) / 3.0 >= 155 AND (outline_r + outline_g + outline_b) / 3.0 <= 95), {_cleaned("tm", "pl")},
ok AS (SELECT video_id, min(idx) AS idx FROM (SELECT video_id, idx FROM tm GROUP BY video_id, idx HAVING count(*) / 49::DOUBLE < 0.30) GROUP BY video_id),
tu AS (SELECT video_id, idx AS tuned_idx, {", ".join(NAMES)} FROM ok JOIN pl USING (video_id, idx))"""
PACKED_ROWS = f"""{TUNED},
co AS (SELECT ch.video_id, ch.idx, {", ".join(f"CASE WHEN ch.idx >= tuned_idx THEN {n} ELSE {255 if n.startswith('main') else 0} END AS {n}" for n in NAMES)} FROM ch LEFT JOIN tu USING (video_id)), {_cleaned("fm", "co")},
cr AS (SELECT ch.video_id, ch.idx, change_mask, coalesce(f.mask, 0::UBIGINT) AS mask, coalesce(lag(f.mask) OVER (PARTITION BY ch.video_id ORDER BY ch.idx), 0::UBIGINT) AS before
  FROM ch LEFT JOIN (SELECT video_id, idx, bit_or(1::UBIGINT << (55 - pos)) AS mask FROM fm GROUP BY video_id, idx) f USING (video_id, idx)),
ck AS (SELECT *, CASE WHEN mask <> 0 AND (before = 0 OR bit_count(mask & before) / bit_count(mask | before)::DOUBLE < 0.7) THEN 'candidate'
  WHEN mask = 0 AND before <> 0 THEN 'close' WHEN mask = 0 AND change_mask <> 0 THEN 'filtered' END AS kind FROM cr)"""


def packed_rip(spark, d):
    return rip_frames(packed_frames(spark, d), RIP_CONFIG)


@query("wn_packed_tuned", f"WITH RECURSIVE {TUNED} SELECT * FROM tu")
def wn_packed_tuned(spark, d):
    t = tuned(changes(packed_frames(spark, d), RIP_CONFIG))
    at = lambda w, k: F.col(w)[k].cast("long")
    return t.select("video_id", "tuned_idx", *[at(w, k).alias(f"{w}_{c}") for w in ("main", "outline") for k, c in enumerate("rgb")])


@query(
    "src_probe",
    f"""WITH RECURSIVE {PIXELS}, o AS (SELECT unnest([-1, 0, 1]) AS o), {DIFFED}, {COLOURS},
    w0 AS (SELECT DISTINCT video_id, idx, 255 AS main_r, 255 AS main_g, 255 AS main_b, 0 AS outline_r, 0 AS outline_g, 0 AS outline_b FROM px), {_cleaned("dm", "w0", 8)},
    st AS (SELECT video_id, idx, count(*) AS n, sum(r + g + b) / 192.0::DOUBLE AS mean, least(min(r), min(g), min(b)) AS low, greatest(max(r), max(g), max(b)) AS high,
      string_agg(format('{{:02X}}{{:02X}}{{:02X}}', r, g, b), '' ORDER BY pos) FILTER (pos < 3) AS first FROM px GROUP BY video_id, idx),
    cn AS (SELECT video_id, idx, count(*) FILTER (changed) AS changed, count(*) FILTER (changed) / count(*)::DOUBLE AS ratio FROM chg GROUP BY video_id, idx)
    SELECT st.*, changed, ratio, CASE WHEN changed >= 0 THEN coalesce(r.raw, 0) END AS raw, CASE WHEN changed >= 0 THEN coalesce(c.clean, 0) END AS clean,
      CASE WHEN changed >= 0 THEN concat_ws(',', coalesce(main_r, 255), coalesce(main_g, 255), coalesce(main_b, 255)) END AS main, CASE WHEN changed >= 0 THEN concat_ws(',', coalesce(outline_r, 0), coalesce(outline_g, 0), coalesce(outline_b, 0)) END AS outline,
      CASE WHEN changed >= 0 THEN coalesce((main_r + main_g + main_b) / 3.0 >= 155 AND (outline_r + outline_g + outline_b) / 3.0 <= 95, true) END AS plausible
    FROM st LEFT JOIN cn USING (video_id, idx) LEFT JOIN au USING (video_id, idx) LEFT JOIN (SELECT video_id, idx, count(*) AS raw FROM dm_h GROUP BY ALL) r USING (video_id, idx) LEFT JOIN (SELECT video_id, idx, count(*) AS clean FROM dm GROUP BY ALL) c USING (video_id, idx)""".replace("SELECT st.*, changed", "SELECT st.video_id, st.idx, st.n, mean, low, high, first, changed"),
)
def src_probe(spark, d):
    """Statistics of every frame, and of its difference, default filter and colours."""
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return probe(packed_frames(spark, d), Config()).withColumns({"first": F.hex("first"), "main": listed("main"), "outline": listed("outline")})


PACKED = f"""WITH RECURSIVE {PACKED_ROWS},
rr AS (SELECT video_id, idx, idx / 25.0::DOUBLE AS time, mask, kind = 'close' AS close_only FROM ck WHERE kind IN ('candidate', 'close')),
{FOLD.format(rows="rr", zero="0::UBIGINT")}, {MERGE.format(rows="se", order="event_no", force="false", gap="0.08::DOUBLE")}"""
# An event's image is the box of its source frame's region; where events merge, later boxes lie over earlier ones.
IMAGES = """gr AS (SELECT DISTINCT pos, x, y FROM px),
mg AS (SELECT mf.video_id, mf.g, me.k, me.mask, me.source_frame FROM mf JOIN me USING (video_id, k)),
eb AS (SELECT mg.video_id, g, k, source_frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mg JOIN gr ON (mask >> (55 - pos)) & 1 = 1 GROUP BY ALL),
ub AS (SELECT video_id, g, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM eb GROUP BY video_id, g),
cut AS (SELECT eb.video_id, eb.g, eb.k, px.x, px.y, format('{:02X}{:02X}{:02X}', px.r, px.g, px.b) AS c
  FROM eb JOIN px ON px.video_id = eb.video_id AND px.idx = eb.source_frame AND px.x BETWEEN eb.x0 AND eb.x1 AND px.y BETWEEN eb.y0 AND eb.y1),
im AS (SELECT ub.video_id, ub.g, gr.y, gr.x, coalesce(arg_max(c, k), '000000') AS c FROM ub JOIN gr ON gr.x BETWEEN x0 AND x1 AND gr.y BETWEEN y0 AND y1
  LEFT JOIN cut ON cut.video_id = ub.video_id AND cut.g = ub.g AND cut.x = gr.x AND cut.y = gr.y GROUP BY ALL),
pic AS (SELECT video_id, g, string_agg(c, '' ORDER BY y, x) AS image FROM im GROUP BY video_id, g)"""


@query(
    "rip_packed_events",
    f"""{PACKED}, {IMAGES}, done AS (SELECT video_id, g, g AS event_no, arg_min(start, k) AS start, arg_max("end", k) AS "end", arg_min(start_frame, k) AS start_frame, arg_max(end_frame, k) AS end_frame,
    sum(n)::BIGINT AS n, format('{{:014X}}', bit_or(mask)) AS mask, arg_max(source_frame, k) AS source_frame FROM mf JOIN me USING (video_id, k) GROUP BY video_id, g)
    SELECT done.* EXCLUDE (g), 7 AS roi_w, 7 AS roi_h, '1,1' AS roi_origin, concat_ws(',', x0, y0, x1 - x0 + 1, y1 - y0 + 1) AS bbox, image FROM done JOIN ub USING (video_id, g) JOIN pic USING (video_id, g)""",
)
def rip_packed_events(spark, d):
    """The rip as users start it: region, differences, tuned colours, filter with dilation, clean-up, events, merging."""
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    events = packed_rip(spark, d).events
    return events.select("video_id", "event_no", "start", "end", "start_frame", "end_frame", "n", F.hex("mask").alias("mask"), "source_frame", "roi_w", "roi_h", listed("roi_origin"), listed("bbox"), F.hex("image").alias("image"))


@query(
    "ag_rip_report",
    f"""{PACKED}, fr AS (SELECT video_id, idx, idx / 25.0::DOUBLE AS time, change_mask AS mask, false AS close_only FROM ck WHERE kind = 'filtered'),
    fs AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k FROM fr),
    ff(video_id, k, no, u, last) AS (SELECT video_id, k, 1, mask, idx FROM fs WHERE k = 1 UNION ALL
      SELECT s.video_id, s.k, CASE WHEN j.same THEN f.no ELSE f.no + 1 END, CASE WHEN j.same THEN f.u | s.mask ELSE s.mask END, s.idx FROM ff f JOIN fs s ON s.video_id = f.video_id AND s.k = f.k + 1,
      LATERAL (SELECT bit_count(f.u & s.mask) / bit_count(f.u | s.mask)::DOUBLE >= 0.7 OR s.idx - f.last <= 5 AS same) j)
    SELECT video_id, frames_processed, coalesce(change_frames, 0) AS change_frames, coalesce(events, 0) AS events, coalesce(filtered, 0) AS filtered
    FROM (SELECT video_id, count(DISTINCT idx) AS frames_processed FROM px GROUP BY video_id)
    LEFT JOIN (SELECT video_id, count(*) AS change_frames FROM cr GROUP BY video_id) USING (video_id)
    LEFT JOIN (SELECT video_id, max(g)::BIGINT AS events FROM mf GROUP BY video_id) USING (video_id)
    LEFT JOIN (SELECT video_id, max(no)::BIGINT AS filtered FROM ff GROUP BY video_id) USING (video_id)""",
)
def ag_rip_report(spark, d):
    """What a run reports per video, from what the one pass over its frames has stored."""
    return packed_rip(spark, d).report()


@query(
    "rip_filtered",
    f"""WITH RECURSIVE {PIXELS}, {DIFFED}, {CANDIDATE_ROWS}, rr AS (SELECT video_id, idx, idx / 25.0::DOUBLE AS time, change_mask AS mask, false AS close_only FROM ck WHERE kind = 'filtered'),
    {FOLD.format(rows="rr", zero="0::UBIGINT")} SELECT video_id, event_no, start, "end", start_frame, end_frame, n FROM se""",
)
def rip_filtered(spark, d):
    found = detect.candidates(change_rows(spark, d)).filter("kind = 'filtered'")
    rows = found.select("video_id", "idx", (F.col("idx") / 25.0).alias("time"), "mask", F.lit(False).alias("close_only"))
    return segment(rows).select("video_id", "event_no", "start", "end", "start_frame", "end_frame", "n")


# ---- manager ----

E = f"WITH {EVENTS}"
COLS = 'video_id, position, start, "end", start_frame, end_frame, n, mask, deleted'
TIDY = f'SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start, position) - 1 AS position, start, "end", start_frame, end_frame, n, mask, deleted FROM'
LATE = TIDY.replace("ORDER BY start, position", "ORDER BY start, late, position")
SETTLED = """CAST(CASE WHEN hit THEN round(start * 25) ELSE start_frame END AS BIGINT) AS start_frame, CAST(CASE WHEN hit THEN round("end" * 25) ELSE end_frame END AS BIGINT) AS end_frame,
CAST(CASE WHEN hit THEN greatest(round("end" * 25) - round(start * 25), 1) ELSE n END AS BIGINT) AS n, mask, deleted"""


def _out(df):
    return df.select("video_id", F.col("position").cast("long").alias("position"), "start", "end", "start_frame", "end_frame", "n", "mask", "deleted")


@query("mg_list", f'{E} SELECT video_id, position + 1 AS index, round(start * 100) / 100 AS start, round("end" * 100) / 100 AS "end", start_frame, end_frame, deleted FROM ev')
def mg_list(spark, d):
    return manager.listing(event_table(spark, d))


@query("mg_remove", f"{E} SELECT video_id, position, start, \"end\", start_frame, end_frame, n, mask, deleted OR position IN (1, 3, 9999) AS deleted FROM ev")
def mg_remove(spark, d):
    return _out(manager.remove(event_table(spark, d), [1, 3, 9999]))


@query("mg_purge", f"{E} {TIDY} ev WHERE NOT deleted")
def mg_purge(spark, d):
    return _out(manager.purge(event_table(spark, d)))


@query("mg_recover", f'{E}, a AS (SELECT {COLS} FROM ev WHERE position % 4 <> 1 UNION ALL SELECT video_id, position, start, "end", start_frame, end_frame, n, mask, false FROM ev WHERE position % 4 = 1) {LATE} (SELECT *, position % 4 = 1 AS late FROM a)')
def mg_recover(spark, d):
    e = event_table(spark, d)
    return _out(manager.recover(e.filter("position % 4 <> 1"), e.filter("position % 4 = 1")))


@query(
    "mg_edit",
    f"""{E}, a AS (SELECT video_id, position, CASE WHEN position % 5 = 0 THEN start + 0.25::DOUBLE ELSE start END AS start,
    CASE WHEN position % 5 = 0 AND position % 2 = 0 THEN "end" + 1.5::DOUBLE ELSE "end" END AS "end", start_frame, end_frame, n, mask, deleted, position % 5 = 0 AS hit FROM ev)
    SELECT video_id, position, start, "end", {SETTLED} FROM a""",
)
def mg_edit(spark, d):
    e = event_table(spark, d)
    later = F.when(F.col("position") % 2 == 0, F.col("end") + 1.5)
    edits = e.filter("position % 5 = 0").select("video_id", "position", (F.col("start") + 0.25).alias("new_start"), later.alias("new_end"))
    return _out(manager.edit(e, edits, 25.0))


@query(
    "mg_shift",
    f"""{E}, a AS (SELECT video_id, position, CASE WHEN NOT deleted THEN greatest(start + (-750 / 1000.0::DOUBLE), 0) ELSE start END AS start,
    CASE WHEN NOT deleted THEN greatest("end" + (-750 / 1000.0::DOUBLE), 0) ELSE "end" END AS "end", start_frame, end_frame, n, mask, deleted, NOT deleted AS hit FROM ev)
    SELECT video_id, position, start, "end", {SETTLED} FROM a""",
)
def mg_shift(spark, d):
    return _out(manager.shift(event_table(spark, d), -750, 25.0))


@query(
    "mg_shift_chosen",
    f"""{E}, a AS (SELECT video_id, position, CASE WHEN position IN (0, 2) THEN greatest(start + 0.5::DOUBLE, 0) ELSE start END AS start,
    CASE WHEN position IN (0, 2) THEN greatest("end" + 0.5::DOUBLE, 0) ELSE "end" END AS "end", start_frame, end_frame, n, mask, deleted, position IN (0, 2) AS hit FROM ev)
    SELECT video_id, position, start, "end", {SETTLED} FROM a""",
)
def mg_shift_chosen(spark, d):
    return _out(manager.shift(event_table(spark, d), 500, 25.0, [0, 2]))


# Frames with masks for captures: twenty for each event, three apart, some of them empty.
FRAMES = """fm0 AS (SELECT video_id, position, event_id, unnest(range(0, 20)) AS k FROM e0),
fm AS (SELECT video_id, position * 50 + event_id % 7 + k * 3 AS idx, (position * 50 + event_id % 7 + k * 3) / 25.0::DOUBLE AS time, bit_or((event_id * 37 + k * 11) % 16 * 16) AS mask FROM fm0 GROUP BY ALL)"""
CAPTURED = """{to} AS (SELECT e.* EXCLUDE ("end", end_frame, n, mask), coalesce(t2 + 1.0::DOUBLE / 25.0, "end") AS "end", coalesce(i2, end_frame) AS end_frame, coalesce(n2, n) AS n, coalesce(m2, mask) AS mask, n2 IS NOT NULL AS captured
 FROM {rows} e LEFT JOIN (SELECT e.video_id, e.position, e.half, bit_or(f.mask) AS m2, max(f.idx) AS i2, max(f.time) AS t2, count(*) AS n2
  FROM {rows} e JOIN fm f ON f.video_id = e.video_id AND f.mask <> 0 AND f.idx BETWEEN e.start_frame AND e.end_frame GROUP BY ALL) USING (video_id, position, half))"""


def frame_masks(spark, d):
    """Frames that lie together by video, as a source gives them: events are dealt by video, and nothing is exchanged later."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_id").repartition(spread, "video_id")
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy("video_id").orderBy("event_id")) - 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    idx = F.col("position") * 50 + F.col("event_id") % 7 + F.col("k") * 3
    return rows.groupBy("video_id", idx.alias("idx"), (idx / 25.0).alias("time")).agg(F.bit_or((F.col("event_id") * 37 + F.col("k") * 11) % 16 * 16).alias("mask"))


@query(
    "mg_split",
    f"""{E}, {FRAMES}, s AS (SELECT *, CASE WHEN position = 1 THEN start + 0.5::DOUBLE WHEN position = 2 THEN "end" + 1.0::DOUBLE WHEN position = 3 THEN start + 0.04::DOUBLE END AS t FROM ev),
    g AS (SELECT *, 0 AS half, true AS hit FROM s WHERE t > start AND t < "end" UNION ALL SELECT *, 1 AS half, true AS hit FROM s WHERE t > start AND t < "end"),
    h AS (SELECT video_id, position, half, CASE half WHEN 0 THEN start ELSE t END AS start, CASE half WHEN 0 THEN t ELSE "end" END AS "end", start_frame, end_frame, n, mask, deleted, hit FROM g),
    b AS (SELECT video_id, position, half, start, "end", {SETTLED} FROM h), {CAPTURED.format(to="c", rows="b")},
    ok AS (SELECT video_id, position FROM c GROUP BY ALL HAVING bool_and(captured)),
    a AS (SELECT {COLS}, 0 AS late FROM ev WHERE (video_id, position) NOT IN (SELECT (video_id, position) FROM ok) UNION ALL SELECT {COLS}, half FROM c SEMI JOIN ok USING (video_id, position)) {LATE} a""",
)
def mg_split(spark, d):
    e = event_table(spark, d)
    at = F.when(F.col("position") == 1, F.col("start") + 0.5).when(F.col("position") == 2, F.col("end") + 1.0).otherwise(F.col("start") + 0.04)
    return _out(manager.split(e, e.filter("position in (1, 2, 3)").select("video_id", "position", at.alias("t")), 25.0, frame_masks(spark, d)))


@query(
    "mg_merge",
    f"""{E}, {FRAMES}, o AS (SELECT video_id, max(position) AS position, 0 AS half, min(start) AS start, max("end") AS "end", 0 AS start_frame, 0 AS end_frame, 0 AS n, arg_max(mask, position) AS mask, arg_max(deleted, position) AS deleted, true AS hit
      FROM ev WHERE position IN (1, 2) GROUP BY video_id HAVING count(*) = 2),
    b AS (SELECT video_id, position, half, start, "end", {SETTLED} FROM o), {CAPTURED.format(to="c", rows="b")},
    a AS (SELECT {COLS}, 0 AS late FROM ev WHERE NOT (position IN (1, 2) AND video_id IN (SELECT video_id FROM c WHERE captured)) UNION ALL SELECT {COLS}, 1 FROM c WHERE captured) {LATE} a""",
)
def mg_merge(spark, d):
    return _out(manager.merge(event_table(spark, d), (2, 1), 25.0, frame_masks(spark, d)))


@query(
    "mg_merge_repeat",
    f"""WITH RECURSIVE {EVENTS}, lv AS (SELECT * FROM ev WHERE NOT deleted), {MERGE.format(rows="lv", order="start, position", force="false", gap="1.2::DOUBLE")},
    a AS (SELECT video_id, g - 1 AS position, arg_min(start, k) AS start, arg_max("end", k) AS "end", arg_min(start_frame, k) AS start_frame, arg_max(end_frame, k) AS end_frame, sum(n)::BIGINT AS n, bit_or(mask) AS mask, false AS deleted
      FROM mf JOIN me USING (video_id, k) GROUP BY video_id, g UNION ALL SELECT video_id, position, start, "end", start_frame, end_frame, n, mask, deleted FROM ev WHERE deleted) {LATE} (SELECT *, deleted AS late FROM a)""",
)
def mg_merge_repeat(spark, d):
    return _out(manager.merge_repeat(event_table(spark, d), 1.2))


@query(
    "mg_merge_repeat_removed",
    f"""WITH RECURSIVE {EVENTS}, lv AS (SELECT * FROM ev WHERE NOT deleted), {MERGE.format(rows="lv", order="start, position", force="false", gap="1.2::DOUBLE")}
    SELECT video_id, count(*) - max(g) AS removed FROM mf GROUP BY video_id""",
)
def mg_merge_repeat_removed(spark, d):
    before = event_table(spark, d)
    return manager.removed(before, manager.merge_repeat(before, 1.2))


@query(
    "mg_gallery",
    f"""WITH {EVENTS}, {PICTURES}, pt AS (SELECT *, unnest(['subtitles', 'filtered']) AS part FROM ep), px AS (SELECT unnest(range(0, 8)) AS p),
    rn AS (SELECT video_id, position, string_agg(CASE WHEN (mask >> (7 - p)) & 1 = 1 THEN '0A141E' ELSE 'FAF0E6' END, '' ORDER BY p) AS render FROM ep JOIN px ON p % 4 BETWEEN bx AND bx + bw - 1 AND p // 4 BETWEEN bt AND bt + bh - 1 GROUP BY ALL)
    SELECT video_id, part, position + 1 AS index, round(start * 100) / 100 AS start, round("end" * 100) / 100 AS "end", start_frame, end_frame, n, deleted, concat_ws(',', bx, bt, bw, bh) AS bbox, bw AS image_w, bh AS image_h,
    repeat(printf('%02X', position % 256), bw * bh * 3) AS image, render, bw AS render_w, bh AS render_h FROM pt JOIN rn USING (video_id, position) WHERE part = 'subtitles' OR deleted""",
)
def mg_gallery(spark, d):
    """The manager's listing with each event's image and rendered tile, and the filtered events beside it."""
    e = event_pictures(spark, d)
    found = manager.gallery(e, e.filter("deleted"), Ocr(antialias=False, despeckle_min_area=0, text_color="#0A141E", bg_color="#FAF0E6"))
    return found.withColumns({"bbox": F.array_join(F.col("bbox").cast("array<string>"), ","), "image": F.hex("image"), "render": F.hex("render")})


@query(
    "mg_recapture",
    f"""WITH {EVENTS}, fm AS (SELECT user_id AS video_id, event_id % 2000 AS idx, (event_id % 2000) / 25.0::DOUBLE AS time, bit_or(event_id % 256) AS mask FROM events GROUP BY ALL),
    k AS (SELECT e.video_id, e.position, bit_or(f.mask) AS m2, max(f.idx) AS i2, max(f.time) AS t2, count(*) AS n2 FROM ev e JOIN fm f ON f.video_id = e.video_id AND f.mask <> 0 AND f.idx BETWEEN e.start_frame AND e.end_frame GROUP BY ALL)
    SELECT video_id, position, start, coalesce(t2 + 1.0::DOUBLE / 25.0, "end") AS "end", start_frame, coalesce(i2, end_frame) AS end_frame, coalesce(n2, n) AS n, coalesce(m2, mask) AS mask, deleted FROM ev LEFT JOIN k USING (video_id, position)""",
)
def mg_recapture(spark, d):
    idx = F.col("event_id") % 2000
    frames = table(spark, d, "events").groupBy(F.col("user_id").alias("video_id"), idx.alias("idx"), (idx / 25.0).alias("time")).agg(F.bit_or(F.col("event_id") % 256).alias("mask"))
    return _out(manager.recapture(event_table(spark, d), frames, 25.0))


@query("so_events_by_start", f"{E} {TIDY} ev")
def so_events_by_start(spark, d):
    return _out(manager.numbered(event_table(spark, d)))


@query("fl_live_events", f'{E} SELECT video_id, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS removed FROM ev GROUP BY video_id')
def fl_live_events(spark, d):
    e = event_table(spark, d)
    live = artifacts.live(e).groupBy("video_id").agg(F.count("*").alias("live"))
    return e.groupBy("video_id").agg(F.count("*").alias("n")).join(live, "video_id", "left").na.fill(0).select("video_id", "live", (F.col("n") - F.col("live")).alias("removed"))
