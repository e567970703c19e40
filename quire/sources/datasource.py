"""A Python data source: ``spark.read.format("quire_pdf").option("table", "nodes").load(folder)``.

Files are listed and read through Arrow's file systems (local, HDFS, S3, GCS by
the scheme of the path), many to a partition, and come back in Arrow batches.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.kernels.model import Options
from quire.sources import pdf

PART_BYTES, PART_FILES = 64 << 20, 1000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _list(path: str) -> list[fs.FileInfo]:
    """The files below a folder that end in .pdf, one file, or those that fit a pattern."""
    system, at = _open(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)
    if any(c in at for c in "*?["):
        base = posixpath.dirname(at[: min(at.find(c) for c in "*?[" if c in at)])
        found = system.get_file_info(fs.FileSelector(base or "/", recursive=True, allow_not_found=True))
        return [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, at)]
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        return [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".pdf")]
    return [info] if info.type == fs.FileType.File else []


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, options: str):
        self.path, self.table, self.options = path, table, options

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for f in sorted(_list(self.path), key=lambda f: f.path):
            held.append(f.path)
            size += f.size or 0
            if size >= PART_BYTES or len(held) == PART_FILES:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system = _open(self.path)[0] if "://" in self.path and not self.path.startswith("file:") else fs.LocalFileSystem()

        def batches() -> Iterator[pa.RecordBatch]:
            for i, path in enumerate(partition.paths):
                with system.open_input_stream(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([f.read()], pa.binary())], names=["file_id", "content"])

        for batch in pdf._kernel((self.table,), Options.read(self.options), None, False)(batches()):
            paths = pa.array([partition.paths[i] for i in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([paths, *batch.columns[1:]], names=["path", *batch.schema.names[1:]])


class PdfSource(DataSource):
    """Options: table (a name of ``pdf.TABLES``, nodes by default), options (lines of an option file)."""

    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return f"path STRING, {pdf.TABLES[self.options.get('table', 'nodes')]}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "nodes"), self.options.get("options", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
