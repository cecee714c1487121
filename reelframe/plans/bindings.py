"""Views of the driver tables as frames, pixels, candidates and events, each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a frame of 8 x 8: video_id, idx, pos, x, y, v, r, g, b."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("idx"), F.posexplode("embedding").alias("p", "e"))
    pos, v = F.col("p").cast("long"), F.col("e").cast("double")
    rows = rows.select("video_id", "idx", pos.alias("pos"), (pos % SIDE).alias("x"), F.floor(pos / SIDE).alias("y"), v.alias("v"), ((v + 1.0) * 127.5).cast("long").alias("r"))
    return rows.withColumns({"g": (F.col("r") * 7 + F.col("pos") * 13) % 256, "b": (F.col("r") * 3 + F.col("pos") * 5) % 256})


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of pixels() as packed ones: video_id, idx, rgb (binary), width, height."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("idx"), "embedding")

    def hexes(e, p):
        r = ((e.cast("double") + 1.0) * 127.5).cast("long")
        return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (r, (r * 7 + p * 13) % 256, (r * 3 + p * 5) % 256)])

    rgb = F.unhex(F.array_join(F.transform("embedding", hexes), ""))
    # The table is one small file; frames of a video go to one task, as a table of real frames has them in its files.
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "video_id").select("video_id", "idx", rgb.alias("rgb"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


PIXELS = """px0 AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS idx, CAST(p - 1 AS BIGINT) AS pos, CAST((p - 1) % 8 AS BIGINT) AS x,
  CAST((p - 1) // 8 AS BIGINT) AS y, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS p)),
px1 AS (SELECT *, CAST(trunc((v + 1.0) * 127.5) AS BIGINT) AS r FROM px0),
px AS (SELECT *, (r * 7 + pos * 13) % 256 AS g, (r * 3 + pos * 5) % 256 AS b FROM px1)"""


def pixel_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a pixel: id, idx (its frame), r, g, b."""
    t = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber").cast("long")
    return t.select(
        (F.col("l_orderkey") * 10 + line).alias("id"), F.floor(F.col("l_orderkey") / 64).alias("idx"),
        (F.col("l_orderkey") % 256).cast("long").alias("r"), (F.col("l_partkey") % 256).cast("long").alias("g"),
        ((F.col("l_suppkey") * 37 + line * 11) % 256).cast("long").alias("b"),
    )


STREAM = """st AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey // 64 AS idx, l_orderkey % 256 AS r, l_partkey % 256 AS g,
  (l_suppkey * 37 + l_linenumber * 11) % 256 AS b FROM lineitem)"""


def candidate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a candidate of its user's video: video_id, idx (place among the user's events), time, mask, close_only."""
    t = table(spark, sf_dir, "events")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    idx = (place * 3 + F.col("event_id") % 4).cast("long")
    masks = F.when(F.col("event_id") % 3 == 0, 255).otherwise((F.col("event_id") * 37 + F.col("user_id") * 11) % 255 + 1)
    rows = t.select(F.col("user_id").alias("video_id"), idx.alias("idx0"), masks.cast("long").alias("mask"), (F.col("event_type") == "error").alias("close_only"), "event_id")
    order = F.row_number().over(W.partitionBy("video_id").orderBy("event_id"))
    rows = rows.withColumn("idx", F.col("idx0") * 2 + order % 2)
    return rows.select("video_id", "idx", (F.col("idx") / 25.0).alias("time"), "mask", "close_only")


CANDIDATES = """c0 AS (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place,
  CASE WHEN event_id % 3 = 0 THEN 255 ELSE (event_id * 37 + user_id * 11) % 255 + 1 END AS mask, event_type = 'error' AS close_only FROM events),
cd AS (SELECT video_id, (place * 3 + event_id % 4) * 2 + place % 2 AS idx, ((place * 3 + event_id % 4) * 2 + place % 2) / 25.0 AS time, mask, close_only, place FROM c0)"""


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a manager row: video_id, position, start, end, start_frame, end_frame, n, mask, deleted."""
    t = table(spark, sf_dir, "events")
    e = F.col("event_id")
    rows = t.select(F.col("user_id").alias("video_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("position"), "event_id", "event_type")
    start = F.col("position") * 2.0 + (e % 10) / 10.0
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + 1.0 + (e % 7) / 4.0)
    return rows.select(
        "video_id", "position", "start", "end", F.round(F.col("start") * 25).cast("long").alias("start_frame"), F.round(F.col("end") * 25).cast("long").alias("end_frame"),
        (e % 5 + 1).alias("n"), (F.when(e % 3 == 0, 255).otherwise((e * 37) % 255 + 1)).cast("long").alias("mask"), (F.col("event_type") == "error").alias("deleted"),
    )


EVENTS = """e0 AS (SELECT user_id AS video_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events),
e1 AS (SELECT *, position * 2.0::DOUBLE + (event_id % 10) / 10.0::DOUBLE AS start FROM e0),
e2 AS (SELECT *, start + 1.0::DOUBLE + (event_id % 7) / 4.0::DOUBLE AS "end" FROM e1),
ev AS (SELECT video_id, position, start, "end", CAST(round(start * 25) AS BIGINT) AS start_frame, CAST(round("end" * 25) AS BIGINT) AS end_frame,
  event_id % 5 + 1 AS n, CASE WHEN event_id % 3 = 0 THEN 255 ELSE (event_id * 37) % 255 + 1 END AS mask, event_type = 'error' AS deleted FROM e2)"""


def event_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_table() as a rip's events: the mask's eight bits over a region of 4 x 2 at (3, 5), their box and an image of it."""
    rows = event_table(spark, sf_dir)
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda p: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(7) - p)) != 0)
    x, y = F.transform(places, lambda p: p % 4), F.transform(places, lambda p: F.call_function("div", p, F.lit(4)))
    size = lambda v: (F.array_max(v) - F.array_min(v) + 1).cast("long")
    box = F.array(F.array_min(x).cast("long"), F.array_min(y).cast("long"), size(x), size(y))
    rows = rows.withColumn("bbox", box)
    image = F.unhex(F.repeat(F.lpad(F.hex(F.col("position") % 256), 2, "0"), (F.col("bbox")[2] * F.col("bbox")[3] * 3).cast("int")))
    return rows.withColumns({
        "mask": F.unhex(F.lpad(F.hex("mask"), 2, "0")), "roi_w": F.lit(4), "roi_h": F.lit(2), "roi_origin": F.array(F.lit(3).cast("long"), F.lit(5).cast("long")), "image": image, "source_frame": F.col("end_frame"),
    })


PICTURES = """pp AS (SELECT video_id, position, min(p % 4) AS bx, min(p // 4) AS bt, max(p % 4) - min(p % 4) + 1 AS bw, max(p // 4) - min(p // 4) + 1 AS bh FROM ev CROSS JOIN (SELECT unnest(range(0, 8)) AS p) WHERE (mask >> (7 - p)) & 1 = 1 GROUP BY video_id, position),
ep AS (SELECT ev.*, bx, bt, bw, bh FROM ev JOIN pp USING (video_id, position))"""
