"""Sending this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp(prefix="tabulon-ship-")
        atexit.register(shutil.rmtree, folder, True)
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(f"{folder}/tabulon_pkg.zip", "w") as z:
            for p in sorted((root / "tabulon").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(f"{folder}/tabulon_pkg.zip")
        _shipped.add(app)
