"""Puts this package on the path of a session's Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once for each Spark application.

    Also turns off the partitioning that Spark 4.1 claims for unions: when adaptive execution coalesces the
    sides differently, such a union fails with "Can't zip RDDs with unequal numbers of partitions". Rows hold
    whole texts, so Arrow batches are kept to 1,000 rows and 16 MB, unless the session bounds them closer.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    for name, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch("([0-9]+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    if getattr(context, "_corvane_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "corvane.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"corvane/{p.relative_to(root)}")
    context.addPyFile(target)
    context._corvane_shipped = True
    return spark
