"""What the operators of this subpackage share: the shared work folder, staged tables and exact integer helpers.

Nothing is written outside the folder that the session names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset and the session runs in one process (tests), a temporary folder takes its place; on a cluster an
    unset folder is an error, since executors would not see the driver's files.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="lodestrata-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, used once."""
    return f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives a lost executor, and gives
    expressions that differ between evaluations (row numbers of a scan) one fixed value."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    if _recording:
        _recording[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``stage`` writes inside the block, and of no others."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.pop()


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables, for a caller that knows that no DataFrame reads them any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how wide keyed work is dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
