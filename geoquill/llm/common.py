"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])

#: Words are runs of anything but space and the five ASCII controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and have a checkpoint folder.

    The folder is the one the cluster names in spark.checkpoint.dir; one of our own is made only where that is unset.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    sc.environment.setdefault("OMP_NUM_THREADS", "1")  # one task, one core: numpy's own threads would fight over them
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a folder of this machine serves a local session alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="geoquill-"))
    return named or sc.getCheckpointDir()


class _Scopes(threading.local):
    """Folders of tables that the innermost settled() of this thread drops at its end; on the driver only."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/geoquill-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables that the block wrote: for work that gives plain values."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.open.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of build(); the tables that build() wrote on the way are dropped, for nothing reads them any more."""
    with scratch(spark):
        made = build()
        own, _SCOPES.open[-1] = _SCOPES.open[-1], []
        out = write_table(made, name)
        kept, _SCOPES.open[-1] = _SCOPES.open[-1], own
    if _SCOPES.open:
        _SCOPES.open[-1] += kept
    return out


#: Classes of a sieve, and so the most rows that it broadcasts.
SIEVE = 1 << 21


def sieved(df: DataFrame, column: str, wanted: DataFrame, exact: bool = True) -> DataFrame:
    """Rows of df whose hash, a number or hash_128, is in wanted (exact: and no others). Hash classes, at most SIEVE of them and broadcast on that bound, hold back nearly all other rows
    before the shuffle while wanted is small; beyond that they pass, and the join decides."""
    classes = wanted.select(F.pmod(F.xxhash64(column), F.lit(SIEVE)).alias("_class")).distinct()
    some = df.withColumn("_class", F.pmod(F.xxhash64(column), F.lit(SIEVE))).join(F.broadcast(classes), "_class", "left_semi").drop("_class")
    return some.join(wanted.select(column), column, "left_semi") if exact else some


def hash_128(*columns: str) -> Column:
    """128 bits of the columns' values; nulls differ from empty texts."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hash_sample(df: DataFrame, n: int, *keys: str, total: DataFrame | None = None) -> DataFrame:
    """At most n rows of df in the order of a hash of the keys.

    Where df has many more rows, a threshold on the hash lets about 1.5 n of them through first, so no task or driver meets n rows from every
    partition. total: a cheaper table to count in df's place; with fewer rows in df than in it the sample is smaller.
    """
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 32))
    rows = (df if total is None else total).count()
    few = df.where(u < int((1 << 32) * 1.5 * n / rows)) if rows > 2 * n else df
    return few.orderBy(u, *keys).limit(n)
