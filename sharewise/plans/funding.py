"""Grant funding per quarter, with each project's most starred repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.sources.snapshots import is_complete


def funding_by_quarter(funding: DataFrame) -> DataFrame:
    """Total per quarter, funder, pool and project, rounded half away from zero."""
    return funding.groupBy(
        F.date_trunc("quarter", "time").alias("quarter"),
        F.col("from_project_name").alias("funder"),
        "grant_pool_name",
        F.col("to_project_name").alias("project"),
        "to_project_id",
    ).agg(F.round(F.sum("amount")).cast("bigint").alias("total_funding_usd"))


def refresh_funding(spark: SparkSession, path: str, batch: str, facts: DataFrame) -> DataFrame:
    """Add a batch of facts to those under ``path`` and bring the report there up to date.

    Facts lie in a folder a quarter and batch, the report in a folder a quarter, and a write
    replaces just the folders that it fills. So only the quarters that a batch touches are read
    and worked out again, however old they are, and a batch that is written again after a crash
    takes its own place instead of counting twice. Facts are made once, by the write that files
    them. Writers take turns.
    """
    named = facts.withColumns({"part": _part(F.col("time")), "batch": F.lit(batch)})
    _fill(named, f"{path}/facts", "part", "batch")
    known = spark.read.schema(named.schema).parquet(f"{path}/facts")
    # Folders of the batch: those just filled, and any that an earlier write of it has left.
    touched = known.filter(F.col("batch") == batch).select("part").distinct()
    parts = [r["part"] for r in touched.collect()]  # quarters are few
    if parts:
        totals = funding_by_quarter(known.filter(F.col("part").isin(parts)))
        totals = totals.withColumn("part", _part(F.col("quarter")))
        _fill(totals, f"{path}/report", "part")
    shape = funding_by_quarter(facts).withColumn("part", F.lit("")).schema
    if not is_complete(spark, f"{path}/report/*"):
        return spark.createDataFrame([], shape).drop("part")
    return spark.read.schema(shape).parquet(f"{path}/report").drop("part")


def _part(time: Column) -> Column:
    """The folder of a time's quarter; facts without a time have one of their own."""
    return F.coalesce(F.concat(F.year(time), F.lit("Q"), F.quarter(time)), F.lit("none"))


def _fill(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def top_repo(repositories: DataFrame, urls: Sequence[str] | None = None) -> DataFrame:
    """Each project's repository with the most stars; equal stars go to the later name."""
    if urls is not None:
        repositories = repositories.filter(F.col("artifact_url").isin(list(urls)))
    ranked = F.when(
        F.col("star_count").isNotNull(), F.struct("star_count", "artifact_url")
    )
    return repositories.groupBy("project_id").agg(
        F.max(ranked)["artifact_url"].alias("project_repo")
    )


def funding_with_repo(
    funding: DataFrame, repositories: DataFrame, urls: Sequence[str] | None = None
) -> DataFrame:
    """Funding of the projects that have a repository; the project id is dropped."""
    totals = funding_by_quarter(funding)
    repos = top_repo(repositories, urls).withColumnRenamed("project_id", "to_project_id")
    # Both sides are aggregates; adaptive execution picks the join from their real sizes.
    return totals.join(repos, "to_project_id").drop("to_project_id")


def repo_lookup(repositories: DataFrame, urls: Sequence[str]) -> DataFrame:
    """Named repositories with their counts and dates."""
    return repositories.filter(F.col("artifact_url").isin(list(urls))).select(
        F.col("artifact_url").alias("target"),
        "is_fork",
        "star_count",
        "fork_count",
        "created_at",
        "updated_at",
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
