"""Tables that are published in one step: built once, or kept up to date by key.

A whole snapshot is written beside its place and renamed into it. A table that is topped up is a
folder of parts and a list of numbered versions, each a small file that names the parts that
count; a version is published by renaming its file to the next number. Either way a rename that
finds its target taken fails, so of two writers one wins and the other goes on from what the
first has published, and whatever a crashed writer left behind is never read. (The file system
must rename without replacing, as HDFS and local disks do.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = "_versions"
#: Parts that a read puts together; one more, and the next commit makes one part of them.
MOST_PARTS = 16
ATTEMPTS = 20


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds files that can be read, whoever wrote them."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path")
        return not files.isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename without replacing; false if ``target`` is there already."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    old, new = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(old.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    plain = gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(old, new, plain)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _read(spark, path, fmt, schema):
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def _write(df, path, fmt):
    """Beside ``path`` first. Never replaces anything: who finds another's files there uses
    those, and a folder that is there and holds no file is left to its owner."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    writer = df.write.format(fmt).mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).save(beside)
    if not rename_new(spark, beside, path) and not is_complete(spark, path):
        raise FileExistsError(f"{path} is there and holds no table")


def materialize_once(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    schema: T.StructType | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """The snapshot at ``path`` if files are there, else ``build()`` written there first.

    A hit does not call ``build`` at all, so it ignores what would have been asked of it.
    """
    return materialize_together(spark, {path: (build, schema)}, fmt)[path]


def materialize_together(
    spark: SparkSession,
    builders: dict[str, tuple[Callable[[], DataFrame], T.StructType | None]],
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Several snapshots; each that is missing is built, none that is there is touched."""
    out = {}
    for path, (build, schema) in builders.items():
        if not is_complete(spark, path):
            built = build()
            schema = schema or built.schema
            _write(built, path, fmt)
        if schema is None:
            schema = spark.read.format(fmt).option("header", True).load(path).schema
        out[path] = _read(spark, path, fmt, schema)
    return out


# --- tables kept up to date by key ---------------------------------------------------------


def current_version(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The newest version and its parts; 0 and none before the first commit."""
    try:
        listed = spark.read.option("wholetext", True).text(f"{path}/{VERSIONS}/*.json")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    newest = listed.select(F.from_json("value", "version bigint, parts array<string>").alias("v"))
    found = newest.agg(F.max_by("v", "v.version").alias("v")).first()["v"]
    return (found["version"], list(found["parts"])) if found else (0, [])


def publish(spark: SparkSession, path: str, version: int, parts: list[str]) -> bool:
    """Make ``parts`` the table; false if another writer has published that version first."""
    jvm = spark._jvm
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSIONS}/.{uuid.uuid4().hex}")
    out = beside.getFileSystem(configuration).create(beside, False)
    out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
    out.close()
    return rename_new(spark, beside.toString(), f"{path}/{VERSIONS}/{version:012d}.json")


def newest_by_key(rows: DataFrame, key: Column, newest: str) -> DataFrame:
    """One row a key: the one with the largest ``newest``; a null is older than any value, and
    equally new rows go by their other columns, so every reader takes the same one."""
    names = rows.columns
    whole = F.struct(newest, *[c for c in names if c != newest])
    kept = rows.groupBy(key.alias("__key")).agg(F.max(whole).alias("row"))
    return kept.select(*[F.col(f"row.{c}").alias(c) for c in names])


def read_versioned(
    spark: SparkSession, path: str, schema: T.StructType, key: Column, newest: str
) -> DataFrame | None:
    """The newest published version, or none."""
    _, parts = current_version(spark, path)
    return _merged(spark, path, parts, schema, key, newest) if parts else None


def _merged(spark, path, parts, schema, key, newest) -> DataFrame:
    rows = spark.read.schema(schema).parquet(*[f"{path}/{part}" for part in parts])
    return newest_by_key(rows, key, newest)


def commit(
    spark: SparkSession,
    path: str,
    change: Callable[[DataFrame | None], DataFrame],
    schema: T.StructType,
    key: Column,
    newest: str,
) -> DataFrame:
    """Publish what ``change`` adds to the table it is given (none before the first commit), and
    return the table.

    Only the added rows are written; for a key that is there the newer row counts, so a record
    that comes late cannot undo a newer one. If another writer publishes first, ``change`` is
    asked again, on what that writer has published.
    """
    for _ in range(ATTEMPTS):
        version, parts = current_version(spark, path)
        have = _merged(spark, path, parts, schema, key, newest) if parts else None
        added, kept = change(have).select(*schema.fieldNames()), parts
        if len(parts) >= MOST_PARTS:
            added, kept = newest_by_key(have.unionByName(added), key, newest), []
        part = f"part-{uuid.uuid4().hex}"
        added.write.parquet(f"{path}/{part}")
        if publish(spark, path, version + 1, [*kept, part]):
            return _merged(spark, path, [*kept, part], schema, key, newest)
    raise RuntimeError(f"{path}: other writers came first {ATTEMPTS} times")
