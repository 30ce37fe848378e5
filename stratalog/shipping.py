"""Make this package importable by Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    Spark's file server hands the archive out, so the executors need no shared
    folder and no PYTHONPATH of their own.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    fd, archive = tempfile.mkstemp(prefix=f"{_PACKAGE.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, str(Path(_PACKAGE.name) / source.relative_to(_PACKAGE)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
