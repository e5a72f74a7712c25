"""Making the package importable on the executors, whatever their Python path is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application. The file is served by the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="pathlume-sources-"), "pathlume_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(p for p in home.rglob("*") if p.suffix in (".py", ".txt", ".json")):
            archive.write(source, str(source.relative_to(home.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shipped(query):
    """A query that ships the package first."""

    @wraps(query)
    def run(spark: SparkSession, data_dir: str):
        ship(spark)
        return query(spark, data_dir)

    return run
