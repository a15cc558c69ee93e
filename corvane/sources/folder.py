"""A folder collection as a data source: spark.read.format("collection").load(base).

Rows are files: (source_path, owner_dept, doc_type, sensitivity, size, text). Filters on
department and type reach the listing, so that other folders are not walked and other files
not opened; files are dealt to tasks by their sizes. The folder is read with plain file calls
on every executor, so it must be on storage that all of them mount; other stores are read by
files.markdown.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from corvane.functions.access import DEPARTMENTS

SCHEMA = "source_path string, owner_dept string, doc_type string, sensitivity string, size long, text string"
#: Bytes of files that one task reads, unless one file has more; texts of one batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
TYPES = {"md": "md", "csv": "csv"}


@dataclass
class Files(InputPartition):
    """Files of one task: (path, department, type, size)."""

    files: list[tuple[str, str, str, int]]


def default_sensitivity(dept: str, kind: str) -> str:
    """As the Column of the same name."""
    return "general" if dept == "general" else "restricted" if (dept, kind) == ("hr", "csv") else "internal"


class CollectionReader(DataSourceReader):
    def __init__(self, base: str, task_bytes: int):
        self.base, self.task_bytes = base.rstrip("/"), task_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if name in ("owner_dept", "doc_type"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def found(self) -> list[tuple[str, str, str, int]]:
        """The files that the filters leave, by path."""
        out = []
        for dept in DEPARTMENTS:
            if dept not in self.wanted.get("owner_dept", {dept}):
                continue
            for folder, _, names in os.walk(os.path.join(self.base, dept)):
                for name in names:
                    kind = TYPES.get(name.rpartition(".")[2].lower()) if "." in name else None
                    if kind and kind in self.wanted.get("doc_type", {kind}):
                        path = os.path.join(folder, name)
                        out.append((path, dept, kind, os.path.getsize(path)))
        return sorted(out)

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for f in self.found():
            if out[-1].files and size + f[3] > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].files.append(f)
            size += f[3]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, dept, kind, n in partition.files:
            with open(path, encoding="utf-8", errors="ignore", newline="") as f:
                rows.append((f"file://{path}", dept, kind, default_sensitivity(dept, kind), n, f.read()))
            size += n
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(),) * 4 + (pa.int64(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Collection(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CollectionReader:
        base = self.options.get("path", "")
        return CollectionReader(base.removeprefix("file://"), int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session; without the setting, filters of Python sources stay behind the read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Collection)
