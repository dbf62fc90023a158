"""Prepares a session: the package for its Python workers, and batches that fit whole texts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS = 1000
#: A batch on its way to Python ends with the row that passes this: it lies in direct memory several times over.
BATCH_BYTES = 2 << 20
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a Spark application: hand the package to the executors as ``--py-files`` would.

    Batches are set to so many rows and bytes that a batch of whole texts, or of blocks, takes megabytes, not tens of them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="armscope-"), "armscope_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
