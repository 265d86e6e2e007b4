"""Sending this package to the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch at most.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once per application, and bounds the batches
    that Python gets: texts, images and vectors may be long, and a batch is held several times
    over.  The bound is a session setting that stays (frames run later than they are made); a
    lower one is left alone.

    Python workers import the operators' functions by name, so they need the package even where
    the driver found it through its working directory.
    """
    for key, most in _BATCH.items():
        if not 0 < int(spark.conf.get(key, "0")) <= most:  # 0 and less: unlimited
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodestone-ship-")), "lodestone_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
