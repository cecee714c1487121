"""Command line: dump-config, and rip for files of uncompressed frames."""

from __future__ import annotations

import argparse
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .logs import open_log
from .operators.rip import Rip
from .operators.rip import rip as rip_frames
from .progress import watched
from .session import send_package
from .shared import stored
from .sources import files, frames, writers


def rip(spark: SparkSession, path: str, cfg: Config, **options) -> Rip:
    """The rip of every frame file under path: region, range, steps, filter and clean-up of the configuration take effect.

    Each video has its own rate, from its header, name or options; the list of files is the driver's.
    """
    rates = {os.path.basename(c.path): c.fps for c in frames.clips(path, **options)}
    if not rates:
        raise FileNotFoundError(f"no frame files in {path}")
    seconds = F.lit(next(iter(rates.values())))
    if len(set(rates.values())) > 1:
        seconds = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("video_id")]
    return rip_frames(frames.load(spark, path, cfg, **options), cfg, seconds)


def table(events: DataFrame) -> DataFrame:
    """A rip's events as a manager's table: numbered by position, none deleted; stored, since every artifact reads it."""
    rows = events.withColumns({"position": F.col("event_no").cast("long") - 1, "deleted": F.lit(False)})
    return stored(rows, "table")


def export(spark: SparkSession, found: Rip, path: str, out: str, cfg: Config, **options) -> DataFrame:
    """Writes every artifact of a rip as files below out, at each video's own size; returns their map.

    The map has a row for every artifact; a video without events has neither rows nor files.
    """
    events, filtered = table(found.events), table(found.filtered)
    rows = None
    by_size: dict[tuple[int, int], list[str]] = {}
    for c in frames.clips(path, **options):
        by_size.setdefault((c.width, c.height), []).append(os.path.basename(c.path))
    for (width, height), names in by_size.items():
        own = F.col("video_id").isin(names)
        part = writers.everything(events.filter(own), cfg, width, height, filtered.filter(own))
        rows = part if rows is None else rows.unionByName(part)
    return files.write_files(rows, out)


def states(spark: SparkSession, found: Rip, path: str, **options) -> DataFrame:
    """One row for each file of a batch: video_id, state (done, or empty if no frame was read), and the counts of the report."""
    names = spark.createDataFrame([(os.path.basename(c.path), c.frames) for c in frames.clips(path, **options)], "video_id string, frame_count bigint")
    both = names.join(found.report(), "video_id", "left").na.fill(0)
    return both.withColumn("state", F.when(F.col("frames_processed") > 0, "done").otherwise("empty"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="reelframe")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("dump-config")
    p = verbs.add_parser("rip")
    p.add_argument("frames"), p.add_argument("out")
    p.add_argument("--config"), p.add_argument("--log")
    args = parser.parse_args(argv)
    if args.verb == "dump-config":
        print(Config().to_json())
        return
    spark = SparkSession.builder.getOrCreate()
    send_package(spark)
    cfg = Config.from_json(Path(args.config).read_text()) if args.config else Config()
    logger, _ = open_log(args.log)
    logger.info("rip of %s", args.frames)
    with watched(spark, lambda done, known: logger.debug("%d of %d tasks", done, known)):
        found = rip(spark, args.frames, cfg)
        export(spark, found, args.frames, args.out, cfg)
    for r in states(spark, found, args.frames).orderBy("video_id").collect():  # a line a file
        logger.info("%s: %s, %d frames, %d changed, %d events, %d filtered", r.video_id, r.state, r.frames_processed, r.change_frames, r.events, r.filtered)
    logger.info("written to %s after %.1f s of reading", args.out, found.totals()["pass_s"])


if __name__ == "__main__":
    main()
