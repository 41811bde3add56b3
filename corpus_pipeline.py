"""The corpus pipeline: toxic texts out, one of each near-duplicate group, benchmark leaks out,
personal data replaced, and what remains packed into sequences.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; it is written as Parquet to the shared
folder and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from decimal import Decimal

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.llm import decontam, packing, pii, queries, simhash, toxicity
from sharewise.llm.text import held_out
from sharewise.session import stage


def _new_name(docs: DataFrame) -> str:
    return max(docs.columns, key=len) + "_"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; rows without text stay."""
    labels = queries.table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    score = toxicity.score(docs, toxicity.fit(docs, labels))
    return docs.filter(score < toxicity.THRESHOLD)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id.

    A document is a row's id and text together, so different texts under one id are looked at
    apart and rows that repeat both are one. Rows without an id come last, in the order of
    their texts' digests.
    """
    key = _new_name(docs)
    place = F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(2**63))  # in order as digits
    place = F.coalesce(F.lpad(place.cast("string"), 20, "0"), F.lit("without an id"))
    own = F.concat_ws(" ", place, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    named = docs.withColumn(key, own)
    found = simhash.near_duplicates(named, key=key, shingle=3, max_bits=3)
    kept = found.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    return named.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a row or item without an id goes by its text."""
    key = _new_name(docs)
    own = F.concat(F.lit("text "), F.sha2(F.col("text"), 256))
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), own))
    items = queries.table(spark, sf_dir, "benchmark")
    items = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), own))
    leaks = decontam.contained(named, items, key=key)
    return named.join(leaks.select(key).distinct(), key, "left_anti").drop(key)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, queries.PII_KEY, counts=None)
    changed = F.length("text").cast(out.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens; a row per piece."""
    return packing.pack_texts(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: Fingerprints, keyed permutations and tokens have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
