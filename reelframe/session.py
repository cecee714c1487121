"""Sending the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Adds this package to the session's Python files once, so that Arrow kernels can be imported on every executor."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="reelframe-"), "reelframe.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
