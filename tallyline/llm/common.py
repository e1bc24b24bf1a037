"""What the operators share: table access, cut points of the lineage, Arrow helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no checkpoint folder (single-machine tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_CLEARED: set[str] = set()
#: Frees the shuffle files of a query once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share. Without
    that setting a local session takes a local folder; on a cluster, where rows written to one would
    be lost, it is an error. The folder goes when the driver's Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or LOCAL_CHECKPOINTS).rstrip('/')}/tallyline/{spark.sparkContext.applicationId}"
    if path not in _CLEARED:
        _CLEARED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session leaves it
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage so that a
    lost executor costs a reread, and lets the shuffle files of the work so far go (a setting of the
    session, made once, unless the user has one)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, None) is None:
        spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialize() result that nothing will read again."""
    path = getattr(df, "_tallyline_path", None)
    if path:
        _remove(df.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


#: Rows that a function sees at a time: bounds the Python objects a task makes of a batch.
SLICE = 1024


def map_arrow(df: DataFrame, f, schema: str, rows: int | None = SLICE) -> DataFrame:
    """mapInArrow for a function from one record batch to a dict of column lists or arrays. Batches go
    to f in slices of at most `rows` rows; None: as Spark sends them."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows or max(whole.num_rows, 1)):
                out = f(whole.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, name: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `size` bytes in the column `name` (strings, or lists of four-byte
    numbers), or of one row."""
    column = batch.column(name)
    lengths = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_nested(column.type) else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
