"""Sending this package to the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker; once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cinderspark-")) / "cinderspark_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
