"""A data sink for artifacts: ``rows.write.format("artifactfiles").option("path", ...).mode("append").save()``.

Rows of (video_id, name, content) become files named name below path, a folder that the driver and all executors share.
Tasks write into a folder of their own run; a commit moves the files to their places and removes the pictures that an
earlier run numbered higher; a failed run leaves nothing.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..shared import stored

_PICTURE = re.compile(r"subtitle_(\d+)(?:_top|_bottom)?\.(\w+)$")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArtifactWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, os.path.join(root, f".run-{uuid.uuid4().hex}")

    def _below(self, top: str, name: str) -> str:
        path = os.path.normpath(os.path.join(top, name))
        if os.path.isabs(name) or not path.startswith(os.path.normpath(top) + os.sep):
            raise ValueError(f"{name!r} is not below the target folder")
        return path

    def write(self, iterator) -> Written:
        own, files = os.path.join(self.staging, uuid.uuid4().hex), []
        for row in iterator:
            path = self._below(own, row.name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(row.content or b"")
            files.append((path, row.name))
        return Written(files)

    def commit(self, messages) -> None:
        highest: dict[tuple[str, str], int] = {}
        kept = set()
        for path, name in (f for m in messages if m is not None for f in m.files):
            target = self._below(self.root, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(path, target)
            kept.add(target)
            if found := _PICTURE.search(name):
                key = os.path.dirname(target), found[2].lower()
                highest[key] = max(highest.get(key, 0), int(found[1]))
        for (folder, ext), most in highest.items():
            for name in os.listdir(folder):
                found = _PICTURE.fullmatch(name)
                if found and found[2].lower() == ext and int(found[1]) > most and os.path.join(folder, name) not in kept:
                    os.remove(os.path.join(folder, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ArtifactFiles(DataSource):
    @classmethod
    def name(cls):
        return "artifactfiles"

    def schema(self):
        return "video_id string, name string, content binary"

    def writer(self, schema, overwrite):
        return ArtifactWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtifactFiles)


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """Writes artifact rows as files below path; returns the map of artifacts: video_id, kind (the name's ending, or the
    folder of numbered pictures) and path, one row for each."""
    register(rows.sparkSession)
    rows = stored(rows.select("video_id", "name", "content"), "artifacts")
    rows.write.format("artifactfiles").option("path", path).mode("append").save()
    folder = F.regexp_extract("name", r"^(.*)/[^/]*$", 1)
    kind = F.when(folder == "", F.regexp_extract("name", r"\.(timeline\.json|\w+)$", 1)).when(folder.endswith("_subs"), F.lit("srt_subs")).otherwise(F.lit("images"))
    target = F.concat(F.lit(path.rstrip("/") + "/"), F.when(folder == "", F.col("name")).otherwise(folder))
    return rows.select("video_id", kind.alias("kind"), target.alias("path")).distinct()
