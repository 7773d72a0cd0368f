"""Bringing the package to the workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session, once, so that Python workers can import
    it wherever they run and whatever their path is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="framelake-")) / "framelake_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("framelake") / p.relative_to(here))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
