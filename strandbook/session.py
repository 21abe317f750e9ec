"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once, for sessions whose workers can't import it."""
    context = spark.sparkContext
    if getattr(context, "_strandbook_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="strandbook-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(name)
    context._strandbook_shipped = True
    return spark
