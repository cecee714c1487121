"""Run logs: a ring of recent lines, files that rotate, and their reading as a DataFrame."""

from __future__ import annotations

import logging
import logging.handlers
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING, FILE_BYTES, BACKUPS = 3000, 4 * 1024 * 1024, 3
LINE = r"^\[([^\]]+)\] \[([A-Z]+)\] (.*)$"


class Ring(logging.Handler):
    """The last RING lines, and how many older ones were dropped."""

    def __init__(self):
        super().__init__()
        self.lines: deque[str] = deque(maxlen=RING)
        self.dropped = 0

    def emit(self, record):
        self.dropped += len(self.lines) == RING
        self.lines.append(self.format(record))

    def tail(self, n: int) -> list[str]:
        return list(self.lines)[-n:] if n > 0 else []


def open_log(path: str | None = None) -> tuple[logging.Logger, Ring]:
    """A logger with a ring and, with a path, a file of at most FILE_BYTES with BACKUPS older ones."""
    logger, ring = logging.getLogger("reelframe"), Ring()
    logger.setLevel(logging.DEBUG)
    handlers = [ring] + ([logging.handlers.RotatingFileHandler(path, maxBytes=FILE_BYTES, backupCount=BACKUPS)] if path else [])
    for h in handlers:
        h.setFormatter(logging.Formatter("[%(asctime)s.%(msecs)03d] [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S"))
        logger.addHandler(h)
    return logger, ring


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """ts, level, msg of log files; other lines are left out."""
    lines = spark.read.text(path).filter(F.col("value").rlike(LINE))
    return lines.select(*[F.regexp_extract("value", LINE, i).alias(c) for i, c in enumerate(("ts", "level", "msg"), 1)])
