"""Gives executors this package's code where they don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    out = os.path.join(tempfile.mkdtemp(), "locusframe.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "locusframe").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
