"""Send this package's Python code to the executors, so that Arrow functions can import it there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(top.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                archive.write(path, path.relative_to(top.parent))
    context.addPyFile(target)
    _sent.add(context.applicationId)
