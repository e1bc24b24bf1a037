"""Releases of a set of tables: written aside, listed with digests, verified, then put in use at once.

A release is a folder of tables under root/versions; its manifest names every file with its size and
SHA-256, worked out in tasks. What is in use is told by the newest of the numbered pointers under
root/pointers, each written whole under another name and renamed to a number that must not be taken: of
two writers one wins, readers see the old release or the new one, and going back is one more pointer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import fs_path

SCHEMA = "table string, file string, bytes long, sha256 string"


class ReleaseError(ValueError):
    """A release that is damaged, absent, or came second."""


def _files(spark: SparkSession, where: str, tables: list[str]) -> DataFrame:
    """table, file, bytes, sha256 of every data file of the tables, read and digested in tasks, a file at a time."""
    out = spark.createDataFrame([], SCHEMA)
    for name in tables:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{where}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = out.unionByName(files.select(F.lit(name).alias("table"), F.regexp_extract("path", rf"/{name}/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    return out


def publish(tables: dict[str, DataFrame], root: str, version: str, facts: dict | None = None, rows_a_file: int = 5_000_000, group_bytes: int = 128 << 20) -> None:
    """Writes the tables of a release, the manifest, its facts and a card that lists tables, columns and
    rows. Files hold at most rows_a_file rows, row groups about group_bytes. A version is written once."""
    spark = next(iter(tables.values())).sparkSession
    where = f"{root}/versions/{version}"
    fs, p = fs_path(spark, where)
    if fs.exists(p):
        raise ReleaseError(f"there is a release {version} already")
    for name, df in tables.items():
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", group_bytes).parquet(f"{where}/{name}")
    listed = _files(spark, where, list(tables)).filter("bytes > 0 and file not like '%_SUCCESS'")
    listed.coalesce(1).write.json(f"{where}/manifest")
    counts = {name: spark.read.parquet(f"{where}/{name}").count() for name in tables}
    card = "\n".join([f"# {version}", "", "| table | rows | columns |", "| --- | --- | --- |", *(f"| {n} | {counts[n]} | {', '.join(f'{c} {k}' for c, k in df.dtypes)} |" for n, df in tables.items())])
    info = [("facts", json.dumps(facts or {}, sort_keys=True)), ("tables", json.dumps(sorted(tables))), ("card", card)]
    spark.createDataFrame(info, "key string, value string").coalesce(1).write.json(f"{where}/info")


def info(spark: SparkSession, root: str, version: str) -> dict:
    """The facts, tables and card of a release."""
    try:
        found = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{root}/versions/{version}/info").collect()}
    except AnalysisException as e:
        raise ReleaseError(f"there is no whole release {version}") from e
    return {"facts": json.loads(found["facts"]), "tables": json.loads(found["tables"]), "card": found["card"]}


def faults(spark: SparkSession, root: str, version: str) -> DataFrame:
    """table, file, fault ('missing', 'not listed', 'changed') of a release's files; no rows: it is whole."""
    where, tables = f"{root}/versions/{version}", info(spark, root, version)["tables"]
    listed = spark.read.schema(SCHEMA).json(f"{where}/manifest")
    held = _files(spark, where, tables).filter("bytes > 0 and file not like '%_SUCCESS'")
    both = listed.join(held.withColumnsRenamed({"bytes": "b", "sha256": "s"}), ["table", "file"], "full")
    fault = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when((F.col("b") != F.col("bytes")) | (F.col("s") != F.col("sha256")), "changed")
    return both.select("table", "file", fault.alias("fault")).filter("fault is not null")


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, p = fs_path(spark, f"{root}/pointers")
    found = []
    for status in fs.listStatus(p) if fs.exists(p) else ():
        name = status.getPath().getName()
        number, _, version = name.partition("-")
        if number.isdecimal():
            found.append((int(number), version))
    return sorted(found)


def current(spark: SparkSession, root: str) -> str | None:
    """The version in use."""
    found = _pointers(spark, root)
    return _read(spark, root, found[-1][0]) if found else None


def _pointer(root: str, number: int) -> str:
    return f"{root}/pointers/{number:012d}"


def _read(spark: SparkSession, root: str, number: int) -> str:
    fs, p = fs_path(spark, _pointer(root, number))
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, version: str, number: int) -> None:
    aside = f"{root}/pointers/.{uuid.uuid4().hex}"
    fs, p = fs_path(spark, aside)
    stream = fs.create(p, False)
    stream.write(bytearray(version.encode()))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(p), fs.makeQualified(fs_path(spark, _pointer(root, number))[1]), options)
    except Exception as e:
        fs.delete(p, False)
        if "AlreadyExists" in str(e):
            raise ReleaseError(f"pointer {number} was written by another") from e
        raise


def install(spark: SparkSession, root: str, version: str, after: int | None = None) -> int:
    """Puts a release in use if all of its files are whole, and returns its pointer's number. after: the
    number of the pointer that this one is to follow, as the caller knew it; if another one came
    between, it is a ReleaseError and nothing changes."""
    bad = faults(spark, root, version).limit(5).collect()
    if bad:
        raise ReleaseError(f"release {version}: " + "; ".join(f"{r['table']}/{r['file']} is {r['fault']}" for r in bad))
    number = (max((n for n, _ in _pointers(spark, root)), default=0) if after is None else after) + 1
    _point(spark, root, version, number)
    return number


def go_back(spark: SparkSession, root: str) -> str:
    """Puts the release before the one in use in use again."""
    used = [_read(spark, root, n) for n, _ in _pointers(spark, root)]
    before = next((v for v in reversed(used) if v != used[-1]), None)
    if before is None:
        raise ReleaseError("there is no release to go back to")
    install(spark, root, before)
    return before


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the release in use. What is read stays that release's, whatever is installed later."""
    version = current(spark, root)
    if version is None:
        raise ReleaseError("no release is in use")
    return spark.read.parquet(f"{root}/versions/{version}/{table}")
