"""Tables in the shared folder: where lineage is cut, on storage that outlives executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset (tests), a temporary one is set for a local master; on a cluster no folder of one
    machine would do, and the setting is asked for.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no later step reads."""
    for path in {re.sub(r"/[^/]*$", "", p) for p in df.inputFiles()}:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all folders that this process made. Results that were not written or collected before cannot be read any more."""
    while _made:
        _delete(spark, _made.pop())


def published(spark: SparkSession, path: str, version: int, text: str) -> None:
    """Writes a numbered version of what lies at path; it fails if the number is taken, so of two writers one is told."""
    rows = spark.createDataFrame([(text,)], "value string").coalesce(1)
    rows.write.mode("errorifexists").text(f"{path.rstrip('/')}/versions/v={version}")


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders under path whose writer ended well, by name."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(base):
        return []
    done = lambda p: store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(f"{path.rstrip('/')}/{s.getPath().getName()}" for s in store.listStatus(base) if s.isDirectory() and done(s.getPath()))


def latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The greatest version at path that is written to its end, and its text; 0 and None where there is none."""
    done = [int(p.rpartition("/v=")[2]) for p in complete_folders(spark, f"{path.rstrip('/')}/versions")]
    if not done:
        return 0, None
    return max(done), spark.read.text(f"{path.rstrip('/')}/versions/v={max(done)}").first()["value"]


_kept: dict[tuple[str, str], tuple[str, object]] = {}


def kept(spark: SparkSession, key: str, make):
    """What make(folder) gave for a key, made once for a Spark application in a folder of its own, until clean()."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _kept or _kept[at][0] not in _made:
        folder = shared_folder(spark)
        _kept[at] = (folder, make(folder))
    return _kept[at][1]
