"""Making this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch on its way to Python, where the session has Spark's own value: long texts would otherwise
#: make batches of 64 MB, each held by the JVM and by the Python worker.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, so that Python functions find their modules there; bound Arrow batches."""
    for key, (usual, ours) in BATCHES.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="reconloom-"), "reconloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
