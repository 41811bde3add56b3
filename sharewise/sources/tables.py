"""Pair tables, project metadata and warehouse tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharewise import schemas
from sharewise.operators.metadata import missing_metadata, project_dimension
from sharewise.operators.pairs import strip_urls
from sharewise.session import stage
from sharewise.sources.snapshots import commit, materialize_together, newest_by_key


def read_pairs_csv(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """A raw pair table: ``id, project_a, project_b`` and, when labelled, both weights."""
    schema = schemas.TRAIN_PAIRS if labelled else schemas.TEST_PAIRS
    return spark.read.schema(schema).option("header", True).csv(path)


#: Commas that are not inside quotes.
_FIELDS = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
DATES = "yyyy-MM-dd'T'HH:mm:ss'Z'"


class MalformedRecords(ValueError):
    """Records that a strict read does not take."""


def _parted(
    rows: DataFrame, reason: Column, record: Column, strict: bool, quarantine: str | None
) -> tuple[DataFrame, DataFrame]:
    """Rows without a ``reason``, and the records of the others with theirs.

    ``rows`` are parsed and staged once, so that both parts, counts and files agree.
    """
    held = stage(rows.select("*", reason.alias("reason")), "parsed")
    bad = held.filter("reason is not null").select(record.alias("record"), "reason")
    if strict:
        counts = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
        if counts:
            raise MalformedRecords(f"malformed records: {counts}")
    if quarantine:
        bad.write.mode("append").parquet(quarantine)
    return held.filter("reason is null").drop("_record", "reason"), bad


def read_pairs_checked(
    spark: SparkSession,
    path: str,
    labelled: bool = True,
    strict: bool = False,
    quarantine: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A raw pair table without its malformed lines, and those lines as ``record, reason``.

    The reason is ``fields`` for a wrong number of them, ``value`` for one of another type and
    ``id`` for none. With ``strict`` any such line is an error; ``quarantine`` names a table
    that they are appended to.
    """
    schema = schemas.TRAIN_PAIRS if labelled else schemas.TEST_PAIRS
    wide = T.StructType([*schema.fields, T.StructField("_record", T.StringType())])
    reader = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_record")
    rows = reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    found = F.size(F.split("_record", _FIELDS))
    reason = (
        F.when(F.col("_record").isNotNull() & (found != len(schema)), "fields")
        .when(F.col("_record").isNotNull(), "value")
        .when(F.col("id").isNull(), "id")
    )
    record = F.coalesce("_record", F.to_csv(F.struct(*schema.fieldNames())))
    return _parted(rows, reason, record, strict, quarantine)


def read_metadata_checked(
    spark: SparkSession, path: str, strict: bool = False, quarantine: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Landed metadata records, and the malformed ones as ``record, reason``.

    The reason is ``json`` for a line that does not fit the schema and ``date`` for a date that
    cannot be read. Empty answers are dropped, they are no error.
    """
    wide = T.StructType([*schemas.REPO_METADATA.fields, T.StructField("_record", T.StringType())])
    reader = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_record")
    rows = reader.option("mode", "PERMISSIVE").json(path)
    dates = [F.col(c) for c in ("created_at", "updated_at")]
    wrong = [d.isNotNull() & F.try_to_timestamp(d, F.lit(DATES)).isNull() for d in dates]
    reason = F.when(F.col("_record").isNotNull(), "json").when(wrong[0] | wrong[1], "date")
    rows = rows.filter("full_name is not null or _record is not null")
    record = F.coalesce("_record", F.to_json(F.struct(*schemas.REPO_METADATA.fieldNames())))
    return _parted(rows, reason, record, strict, quarantine)


def load_pairs(
    spark: SparkSession,
    snapshot_dir: str,
    build_train: Callable[[], DataFrame],
    build_test: Callable[[], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Train and test pairs with project ids for URLs, from raw CSV snapshots that are written
    first unless both exist."""
    train, test = f"{snapshot_dir}/dataset", f"{snapshot_dir}/test"
    tables = materialize_together(
        spark,
        {train: (build_train, schemas.TRAIN_PAIRS), test: (build_test, schemas.TEST_PAIRS)},
        fmt="csv",
    )
    return strip_urls(tables[train]), strip_urls(tables[test])


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed metadata records, one JSON object per line; empty answers are dropped."""
    records = spark.read.schema(schemas.REPO_METADATA).json(path)
    return records.filter(F.col("full_name").isNotNull())


def refresh_metadata(
    spark: SparkSession,
    snapshot: str,
    projects: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The metadata snapshot, topped up with what ``fetch`` lands for projects it lacks.

    Only the missing projects are asked for, each once whatever its case; of a project that
    comes twice, by two answers or two writers, the record with the newest ``updated_at``
    counts. What is added is published in one step (``snapshots.commit``).
    """
    asked = projects.select(F.lower("project").alias("project")).distinct()

    def missing(have: DataFrame | None) -> DataFrame:
        wanted = asked if have is None else missing_metadata(asked, project_dimension(have))
        return _newest(fetch(wanted))

    return commit(spark, snapshot, missing, schemas.REPO_METADATA, F.lower("full_name"), "updated_at")


def merge_metadata(spark: SparkSession, snapshot: str, records: DataFrame) -> DataFrame:
    """The metadata snapshot with ``records``, whatever it has; the newest of each project."""
    return commit(
        spark, snapshot, lambda have: _newest(records), schemas.REPO_METADATA,
        F.lower("full_name"), "updated_at",
    )


def _newest(records: DataFrame) -> DataFrame:
    named = records.filter("full_name is not null").select(*schemas.REPO_METADATA.fieldNames())
    return newest_by_key(named, F.lower("full_name"), "updated_at")


def read_warehouse_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The ``oss_funding`` or ``repositories`` table, with its declared schema."""
    schema = {"oss_funding": schemas.OSS_FUNDING, "repositories": schemas.REPOSITORIES}[name]
    return spark.read.schema(schema).parquet(path)


def warehouse_query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL text over tables that it names in braces; no name outlives the statement."""
    return spark.sql(text, **tables)
