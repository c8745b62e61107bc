"""Making this package importable in the Python workers of any cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_on_workers(spark: SparkSession) -> None:
    """Sends the package to the executors through Spark's own file distribution, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="quillstack-ship-") as own:
        shutil.copytree(root, f"{own}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        keep = tempfile.mkdtemp(prefix="quillstack-zip-")  # on the driver; executors fetch it until the application ends
        atexit.register(shutil.rmtree, keep, True)
        context.addPyFile(shutil.make_archive(f"{keep}/{root.name}", "zip", f"{own}/src"))
    _shipped.add(context.applicationId)
