"""Sending this package to the executors' Python, for the few operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    sc, package = spark.sparkContext, Path(__file__).parents[1]
    if "prosegrain.zip" in sc._python_includes:
        return
    path = Path(tempfile.mkdtemp(prefix="prosegrain-ship-")) / "prosegrain.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
