"""A data source for folders of .npy patches: `spark.read.format("npy_patches").load(folder)`, one row a file, and `df.write.format("npy_patches")`.

Partitions are made of listed files, by size and number. A schema without `data` reads file headers alone, so shapes cost some hundred bytes a file; filters on candidate_id drop files by their names before they are opened,
where the session pushes filters to Python sources (spark.sql.python.filterPushdown.enabled; the option `pushdown` says so) or the option `ids` names them. Files are opened through pyarrow's file systems (local, HDFS, S3, GCS); for a
store that only Spark can read there is `readers.read_patches`.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from geoquill.sources.readers import normalise_layout

SCHEMA = "candidate_id string, n_channels int, height int, width int, data array<float>"
TYPES = {"candidate_id": pa.string(), "n_channels": pa.int32(), "height": pa.int32(), "width": pa.int32(), "data": pa.list_(pa.float32())}
#: Bytes and files of a partition; rows of a batch.
PART_BYTES, PART_FILES, BATCH = 64 << 20, 2_000, 256
#: Bytes that hold the header of nearly every file; the rest is read where they don't.
HEADER = 512


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def candidate(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npy")


def header(start: bytes) -> tuple[tuple[int, ...], np.dtype] | None:
    """Shape and kind of the array whose file begins so; None if the header is longer."""
    stream = io.BytesIO(start)
    try:
        version = np.lib.format.read_magic(stream)
        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    except (ValueError, EOFError):
        return None
    return shape, kind


def layout(shape: tuple[int, ...], kind: np.dtype) -> tuple[int, int, int]:
    """Channels, height and width that normalise_layout gives, from the header."""
    empty = np.lib.stride_tricks.as_strided(np.zeros(1, kind), shape, (0,) * len(shape))
    if kind.names:
        return (len(kind.names), *shape)
    return normalise_layout(empty).shape


@dataclass
class Files(InputPartition):
    paths: list[str]


class PatchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = [f.name for f in schema]
        unknown = set(self.columns) - set(TYPES)
        if unknown:
            raise ValueError(f"no such columns of patches: {sorted(unknown)}")
        self.folder = options["path"]
        self.ids = set(options["ids"].split(",")) if options.get("ids") else None

    def partitions(self) -> list[Files]:
        system, root = file_system(self.folder)
        found = [(f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".npy") and (self.ids is None or candidate(f.path) in self.ids)]
        out, now, size = [], [], 0
        for path, n in sorted(found):
            n = n if "data" in self.columns else HEADER
            if now and (len(now) >= PART_FILES or size + n > PART_BYTES):
                out.append(Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*out, Files(now)] if now else [Files([])]

    def _row(self, system: fs.FileSystem, path: str) -> tuple:
        with system.open_input_file(path) as file:
            if "data" in self.columns:
                a = normalise_layout(np.load(io.BytesIO(file.readall()), allow_pickle=False))
                shape, data = a.shape, a.astype(np.float32).ravel()
            else:
                shape, data = layout(*(header(file.read_at(HEADER, 0)) or header(file.read_at(1 << 20, 0)))), None
        row = {"candidate_id": candidate(path), "n_channels": shape[0], "height": shape[1], "width": shape[2], "data": data}
        return tuple(row[c] for c in self.columns)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        for at in range(0, len(partition.paths), BATCH):
            rows = [self._row(system, p) for p in partition.paths[at : at + BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array(c, TYPES[n]) for n, c in zip(self.columns, zip(*rows, strict=True), strict=True)], names=self.columns)


class FilteringReader(PatchReader):
    """For sessions that push filters; Spark refuses a reader with pushFilters in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            ids = {f.value} if isinstance(f, EqualTo) and f.attribute == ("candidate_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("candidate_id",) else None
            if ids is None:
                yield f
            else:
                self.ids = ids if self.ids is None else self.ids & ids


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class PatchWriter(DataSourceWriter):
    """A file for each row: <candidate_id>.npy of float32 (C, H, W). A task that is run again writes the same files; those of a failed job are deleted."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        paths = []
        for row in iterator:
            stream = io.BytesIO()
            np.save(stream, np.asarray(row["data"], np.float32).reshape(row["n_channels"], row["height"], row["width"]))
            paths.append(f"{root}/{row['candidate_id']}.npy")
            with system.open_output_stream(paths[-1]) as out:
                out.write(stream.getvalue())
        return Written(paths)

    def commit(self, messages: list[Written]) -> None:
        if self.overwrite:
            system, root = file_system(self.folder)
            mine = {p for m in messages if m for p in m.paths}
            for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if f.is_file and f.path.endswith(".npy") and f.path not in mine:
                    system.delete_file(f.path)

    def abort(self, messages: list[Written]) -> None:
        system, _ = file_system(self.folder)
        for path in (p for m in messages if m for p in m.paths):
            if system.get_file_info(path).is_file:
                system.delete_file(path)


class PatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_patches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PatchReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else PatchReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PatchWriter:
        return PatchWriter(self.options, overwrite)


def patch_files(spark: SparkSession, folder: str, columns: tuple[str, ...] = tuple(TYPES), ids: list[str] | None = None) -> DataFrame:
    """Patches of a folder; without data among the columns from file headers alone; only those of the ids, where given."""
    spark.dataSource.register(PatchSource)
    schema = ", ".join(part for part in SCHEMA.split(", ") if part.split(" ")[0] in columns)
    reader = spark.read.format("npy_patches").schema(schema).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("ids", ",".join(ids)) if ids else reader).load(folder)


def write_patch_files(df: DataFrame, folder: str) -> None:
    """A .npy file for each patch (candidate_id, n_channels, height, width, data); files of other patches in the folder stay."""
    df.sparkSession.dataSource.register(PatchSource)
    df.select(*TYPES).write.format("npy_patches").mode("append").save(folder)
