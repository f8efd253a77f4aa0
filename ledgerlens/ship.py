"""Give executors this package, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's modules to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        to = Path(tempfile.mkdtemp(prefix="spark-")) / "ledgerlens_modules.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        context.addPyFile(str(to))
    return spark
