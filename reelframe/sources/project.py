"""Project and timeline documents read back as event tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masks import Packed

ITEM = "struct<index:bigint,start:double,end:double,start_frame:bigint,end_frame:bigint,bbox:array<bigint>,roi_origin:array<bigint>,roi_w:int,roi_h:int,image_w:bigint,image_h:bigint,diff_frames:bigint,source_frame:bigint,deleted:boolean,image_b64:string,mask_b64:string,roi_mask_b64:string>"
PROJECT = f"struct<format:string,version:int,video:string,config:string,artifacts:map<string,string>,filtered:array<{ITEM}>,subtitles:array<{ITEM}>>"


def read_files(spark: SparkSession, path: str, by: str = "video_id") -> DataFrame:
    """Project files, one document each: path as the key, and its content."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(by), F.col("value").alias("content"))


def read_header(documents: DataFrame, by: str = "video_id") -> DataFrame:
    """video (empty if missing), config (the JSON text, {} if missing) and artifacts of project documents."""
    parsed = documents.select(by, F.from_json("content", PROJECT).alias("p"))
    return parsed.select(by, F.coalesce("p.video", F.lit("")).alias("video"), F.coalesce("p.config", F.lit("{}")).alias("config"), F.coalesce("p.artifacts", F.create_map().cast("map<string,string>")).alias("artifacts"))


def read_events(documents: DataFrame, by: str = "video_id", part: str = "subtitles") -> DataFrame:
    """Events of project documents, or with part = filtered their filtered events, as ``artifacts.project`` takes them.

    Missing numbers and boxes are 0, missing buffers empty, a missing deletion mark is no; a mask without a set pixel is
    null.  The box's mask is not read: it is the region's, cut.
    """
    parsed = documents.select(by, F.from_json("content", PROJECT).alias("p"))
    rows = parsed.select(by, F.posexplode(f"p.{part}").alias("at", "s"))
    s = lambda c, d: F.coalesce(F.col(f"s.{c}"), F.lit(d)).alias(c)
    of = lambda c, n: F.array(*[F.coalesce(F.get(F.col(f"s.{c}"), F.lit(k)), F.lit(0).cast("bigint")) for k in range(n)]).alias(c)
    buffer = lambda c: F.unbase64(F.coalesce(F.col(f"s.{c}"), F.lit("")))
    rows = rows.select(
        by, F.col("at").cast("long").alias("position"), s("start", 0.0), s("end", 0.0), s("start_frame", 0), s("end_frame", 0), s("diff_frames", 0).alias("n"),
        buffer("roi_mask_b64").alias("mask"), s("roi_w", 0), s("roi_h", 0), of("roi_origin", 2), of("bbox", 4), buffer("image_b64").alias("image"), s("source_frame", 0), s("deleted", False),
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for b in batches:
            packed = [Packed.pack(np.frombuffer(m, np.uint8) > 0) for m in b.column("mask").to_pylist()]
            yield b.set_column(b.schema.get_field_index("mask"), "mask", pa.array(packed, pa.binary()))

    return rows.mapInArrow(run, kinds)


def read_timeline(documents: DataFrame, by: str = "video_id") -> DataFrame:
    """The events of timeline documents, with their document's count, video size and time shift."""
    kind = "struct<video:struct<width:bigint,height:bigint>,style:struct<time_shift_10ms:bigint>,count:bigint,subtitles:array<struct<index:bigint,start:double,end:double,start_frame:bigint,end_frame:bigint,bbox:array<bigint>,roi_origin:array<bigint>,diff_frames:bigint>>>"
    parsed = documents.select(by, F.from_json("content", kind).alias("p"))
    return parsed.select(by, F.explode("p.subtitles").alias("s"), "p.count", "p.video.width", "p.video.height", "p.style.time_shift_10ms").select(by, "s.*", "count", "width", "height", "time_shift_10ms")
