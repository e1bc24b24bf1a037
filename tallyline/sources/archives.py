"""Zip archives as a data source: the directory of an archive is listed once, its entries are dealt to tasks.

spark.dataSource.register(ZipSource), then spark.read.format("zip_entries").load(path): archive, name, content.
A task opens the archive and reads its own entries by their offsets, so one large archive is read by many
tasks, and no archive is ever a row. Paths are those that Arrow's file systems open (local, s3, gs, hdfs).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .matches import SCHEMA

#: Bytes of unpacked entries that a task reads, and that a batch holds, but for a longer single entry.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
_ENTRY = "archive string, name string, content binary"


class _File(io.RawIOBase):
    """A file of an Arrow file system as zipfile wants it: seeking before its start is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def read(self, size: int = -1) -> bytes:
        return self.file.read(None if size is None or size < 0 else size)

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(path: str):
    store, inside = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    return store, inside


def _archives(path: str) -> list[str]:
    """The archive, or all *.zip files under a folder, in order."""
    store, inside = _open(path)
    if store.get_file_info(inside).type != arrow_fs.FileType.Directory:
        return [path]
    head = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    found = store.get_file_info(arrow_fs.FileSelector(inside, recursive=True))
    return sorted(head + f.path for f in found if f.type == arrow_fs.FileType.File and f.path.endswith(".zip"))


class Entries(InputPartition):
    def __init__(self, archive: str, names: list[str]):
        self.archive, self.names = archive, names


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ending = options["path"], options.get("ending", "")
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Entries]:
        out = []
        for archive in _archives(self.path):
            store, inside = _open(archive)
            with _File(store.open_input_file(inside)) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for entry in sorted((e for e in z.infolist() if not e.is_dir() and e.filename.endswith(self.ending)), key=lambda e: e.header_offset):
                    if held and size + entry.file_size > self.size:
                        out.append(Entries(archive, held))
                        held, size = [], 0
                    held.append(entry.filename)
                    size += entry.file_size
                if held:
                    out.append(Entries(archive, held))
        return out or [Entries("", [])]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        store, inside = _open(partition.archive)
        with _File(store.open_input_file(inside)) as f, zipfile.ZipFile(f) as z:
            names, contents, size = [], [], 0
            for name in partition.names:
                names.append(name)
                contents.append(z.read(name))
                size += len(contents[-1])
                if size > BATCH_BYTES:
                    yield self._batch(partition.archive, names, contents)
                    names, contents, size = [], [], 0
            if names:
                yield self._batch(partition.archive, names, contents)

    def _batch(self, archive: str, names: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(names)), pa.array(names), pa.array(contents, pa.binary())], names=["archive", "name", "content"])


class ZipSource(DataSource):
    """Options: path (an archive or a folder of them), ending (of entries' names), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return _ENTRY

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def entries(spark: SparkSession, path: str, ending: str = ".json", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_entries").option("ending", ending).option("partitionBytes", partition_bytes).load(path)


def documents(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Match documents of zip archives; entries that are no UTF-8 or no JSON are dropped. match_id is the
    entry's name without folder and ending."""
    rows = entries(spark, path, ".json", partition_bytes)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    parsed = rows.select(F.regexp_extract("name", r"([^/]+)\.json$", 1).alias("match_id"), F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    return parsed.select("match_id", "d.*").filter("info is not null")
