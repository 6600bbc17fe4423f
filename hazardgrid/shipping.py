"""Hands this package to the executors, which need not have it on their own path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once an application. Spark serves the
    archive from the driver, so no shared folder is needed."""
    context = spark.sparkContext
    if getattr(context, "_hazardgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "hazardgrid_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    context._hazardgrid_shipped = True
