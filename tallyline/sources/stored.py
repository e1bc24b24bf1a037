"""Derived tables written once and read by every query after: the build step of a ledger."""

from __future__ import annotations

import atexit
import hashlib
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no checkpoint folder.
LOCAL = "/tmp/checkpoints"
_CLEARED: set[str] = set()
#: Tables of this application's catalog that lie in its folder.
_TABLES: list[str] = []
_BUILDING = threading.RLock()


def fs_path(spark: SparkSession, where: str):
    """The file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; it goes when the driver's Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"{(shared or LOCAL).rstrip('/')}/tallyline-derived/{spark.sparkContext.applicationId}"
    if root not in _CLEARED:
        _CLEARED.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session leaves it
        for name in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, p = fs_path(spark, root)
        fs.delete(p, True)


def _table(where: str) -> str:
    """The catalog's name for a stored folder: only there are a table's buckets known."""
    return "spark_catalog.default.tallyline_" + where.rsplit("/", 1)[1].replace("-", "_")


def _save_buckets(df: DataFrame, where: str, bucket: tuple[str, int]) -> None:
    column, n = bucket
    df.write.option("compression", "zstd").bucketBy(n, column).option("path", where).saveAsTable(_table(where), format="parquet")
    _TABLES.append(_table(where))


def cut(df: DataFrame, name: str, bucket: tuple[str, int] | None = None) -> DataFrame:
    """df written to the shared folder and read back: what follows does not repeat what came before, and a
    lost executor costs a reread. bucket: a column and over how many buckets the rows are dealt by it, so that what
    follows by that column needs no exchange."""
    where = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if bucket:
        _save_buckets(df, where, bucket)
        return df.sparkSession.table(_table(where))
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


class Stored(Mapping):
    """Tables by name, built from one another on first use, as Parquet in the shared folder of
    spark.checkpoint.dir. key names the parameters and inputs the paths read: a folder that was
    rewritten since is another version with tables of its own, and so is another application's.

    layout: name -> column that a table is dealt and sorted by in ranges, so that a filter on it reads few
    row groups. The application's folder goes when the driver's Python ends.

    views: names that are not written: what is asked of them decides which columns are made at all.

    buckets: name -> what gives the column that a table is dealt by and over how many buckets: groups, windows and
    joins by that column then need no exchange of it.

    Each build writes a folder of its own, which counts once its write is complete: two builders at
    the same time, or one that failed half-way, leave no rows in each other's table.
    """

    def __init__(self, spark: SparkSession, key: str, builders: dict[str, Callable[[Stored], DataFrame]], inputs: Iterable[str] = (), layout: Mapping[str, str] | None = None, views: Iterable[str] = (), buckets: Mapping[str, Callable[[Stored], tuple[str, int]]] | None = None):
        root = shared_root(spark)
        self.spark, self.builders, self.layout, self.views, self.buckets = spark, builders, layout or {}, frozenset(views), buckets or {}
        version = [key, *(f"{x}@{self._fs(x)[0].getFileStatus(self._fs(x)[1]).getModificationTime()}" for x in inputs)]
        self.path = f"{root}/{hashlib.md5(chr(10).join(version).encode()).hexdigest()}"

    def _fs(self, where: str):
        return fs_path(self.spark, where)

    def _written(self, name: str) -> str | None:
        fs, marks = self._fs(f"{self.path}/{name}-*/_SUCCESS")
        return min((s.getPath().getParent().toString() for s in fs.globStatus(marks) or ()), default=None)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.views:
            return self.builders[name](self)
        with _BUILDING:
            where = self._written(name)
            if where is None:
                where = f"{self.path}/{name}-{uuid.uuid4().hex}"
                df, by = self.builders[name](self), self.layout.get(name)
                if by:
                    df = df.repartitionByRange(by).sortWithinPartitions(by)
                if name in self.buckets:
                    _save_buckets(df, where, self.buckets[name](self))
                else:
                    df.write.option("compression", "zstd").parquet(where)
            if name in self.buckets and self.spark.catalog.tableExists(_table(where)):
                return self.spark.table(_table(where))
        return self.spark.read.parquet(where)

    def flat(self, name: str) -> DataFrame:
        """A stored table as plain files, without its buckets."""
        self[name]  # stores it, if need be
        return self.spark.read.parquet(self._written(name))

    def __iter__(self):
        return iter(self.builders)

    def __len__(self):
        return len(self.builders)
