"""Written tables that cut lineage, in the shared folder the cluster names."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="geoquill-"))
    return named or sc.getCheckpointDir()


class _Scopes(threading.local):
    """Folders that the innermost steps() of this thread drops at its end."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def write_table(df: DataFrame, name: str) -> DataFrame:
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/geoquill-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(folder)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextlib.contextmanager
def steps(spark: SparkSession) -> Iterator[list[str]]:
    """Drops the tables that the block wrote, but not those whose folders it takes out of the list: tables of rounds that nothing reads afterwards."""
    _SCOPES.open.append([])
    try:
        yield _SCOPES.open[-1]
    finally:
        for folder in _SCOPES.open.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(made: list[str], df: DataFrame, name: str) -> DataFrame:
    """df written so that it outlives the innermost steps(), whose list `made` is."""
    out = write_table(df, name)
    made.pop()
    return out
