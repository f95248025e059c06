"""A directory tree as a table: path, kind, size, mode, mtime_ns, ordinal.

A Python data source, since the built-in file sources drop empty and hidden files and know neither modes nor times to the
nanosecond. The driver lists only the first level; each of its folders is a partition that a task walks, so a large tree
is read by many tasks. kind is dir, file or other (links, sockets, devices). The root itself is no row. A folder that
can't be read is an error.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, size bigint, mode bigint, mtime_ns bigint"
_TYPES = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mode", pa.int64()), ("mtime_ns", pa.int64())])
#: Fixed value: the bit that marks a folder in the stored mode.
DIR_BIT = 1 << 31


def local_path(location: str) -> str:
    return unquote(urlparse(location).path) if location.startswith("file:") else location


def _entry(root: str, path: str) -> tuple:
    s = os.lstat(os.path.join(root, path))
    kind = "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
    mode = stat.S_IMODE(s.st_mode) | (DIR_BIT if kind == "dir" else 0)
    return path, kind, s.st_size if kind == "file" else 0, mode, s.st_mtime_ns


def _walk(root: str, path: str) -> Iterator[tuple]:
    """The entry and, of a folder, all below it, each folder before what it holds."""
    todo = [path]
    while todo:
        at = todo.pop()
        row = _entry(root, at)
        yield row
        if row[1] == "dir":
            todo += [f"{at}/{n}" for n in sorted(os.listdir(os.path.join(root, at)), reverse=True)]


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, files: int) -> None:
        self.root, self.files = root, files

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.listdir(self.root))
        folders = [n for n in names if os.path.isdir(os.path.join(self.root, n)) and not os.path.islink(os.path.join(self.root, n))]
        rest = [n for n in names if n not in set(folders)]
        return [_Part([n]) for n in folders] + [_Part(rest[i : i + self.files]) for i in range(0, len(rest), self.files)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path in partition.paths:
            for row in _walk(self.root, path):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


class TreeSource(DataSource):
    """``spark.read.format("filetree").load(folder)``; option ``files``: loose files of the first level per partition."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        root = local_path(self.options["path"])
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        return _Reader(root, int(self.options.get("files", "10000")))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the tree below ``root``; sorting by path puts folders before what they hold."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").load(root)


def size_prescan(tree: DataFrame) -> DataFrame:
    return tree.agg(F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).cast("long").alias("total_bytes"))


def skipped(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count_if(~F.col("kind").isin("file", "dir")).alias("skipped"), F.count_if(F.col("kind") == "file").alias("files"))
