"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams of a bounded, documented sample of labelled rows as a Spark aggregate
and returns a matrix of log probabilities; its size is buckets x languages, whatever the
corpus. ``predict`` broadcasts that matrix and scores whole texts, a sparse row of counts per
text against it.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0;
equal likelihoods go to the language first in alphabetical order; rows with a null or empty
label teach nothing; with no labelled row at all every text is ``und``. An empty table gives no row,
repeated rows get repeated answers. Other columns pass through; the answer is one struct column whose name the
caller chooses, so nothing clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.text import codes, decoded, letter_table, pieces, raw, struct

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BITS = 15
SAMPLE_PER_LANGUAGE = 4000
#: The languages that a model has at most: those with the most rows.
MOST_LANGUAGES = 200
PIECE = 1 << 18
#: Odd multipliers of the hash, one for each order.
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


class NaiveBayes(NamedTuple):
    """``log_prob`` has a row per bucket and a column per language."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text.

    Letters are lower-cased, everything else is a space, and runs of spaces count as one.
    """
    table, total = letter_table(), np.zeros(1 << BITS, np.int64)
    for part in pieces(text, PIECE, max(ORDERS) - 1):
        chars = table[codes(part)]
        keep = chars != 32
        keep[1:] |= chars[:-1] != 32
        chars = chars[keep]
        value = np.zeros(len(chars), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            size = len(chars) - order + 1
            if size <= 0:
                break
            value = value[:size] * np.uint32(_MIX[0]) + chars[order - 1 :]
            if order in ORDERS:
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(_MIX[order % len(_MIX)])
                total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> NaiveBayes:
    """Learn from about ``per_language`` rows of each language, taken by a hash of ``key``.

    The bound is the documented limit of the learning sample; prediction knows none. Of a column
    with more than ``MOST_LANGUAGES`` values those with the most rows are learnt (ties in
    alphabetical order), so the model that is collected stays small.
    """
    labelled = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).filter("lang is not null and lang <> '' and text is not null")
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    sizes = {row["lang"]: row["count"] for row in common.collect()}
    if not sizes:
        return NaiveBayes([], np.zeros((1 << BITS, 0)), np.zeros(0))
    names, fine = sorted(sizes), 1 << 20
    share = F.create_map(
        *[F.lit(x) for n in names for x in (n, max(1, min(fine, fine * per_language // sizes[n])))]
    )
    sample = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(fine)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                counts = gram_counts(decoded(value.as_py()))
                sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            buckets = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(buckets), pa.string()),
                    pa.array(buckets, pa.int32()),
                    pa.array(counts[buckets], pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    rows = (
        sample.select("lang", raw("text").alias("text"))
        .mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros((1 << BITS, len(names)))
    column = {name: i for i, name in enumerate(names)}
    where = np.array([column[x] for x in rows["lang"].to_pylist()], np.int64)
    counts[rows["bucket"].to_numpy(), where] = rows["n"].to_numpy()
    smooth = counts + 0.5
    log_prob = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    prior = np.array([sizes[n] for n in names], float)
    return NaiveBayes(names, log_prob, np.log(prior / prior.sum()))


def classify(text: str, model: NaiveBayes) -> tuple[str, float]:
    """The likeliest language and its posterior probability."""
    counts = gram_counts(text)
    found = np.flatnonzero(counts)
    if not model.languages or not len(found):
        return UNDETERMINED, 0.0
    score = counts[found].astype(np.float32) @ model.log_prob[found] + model.log_prior
    best = int(np.argmax(score))
    return model.languages[best], float(1.0 / np.exp(score - score[best]).sum())


def predict(docs: DataFrame, model: NaiveBayes, text: str = "text") -> Column:
    """A struct of ``lang`` and ``score`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [classify(decoded(x.as_py()), shared.value) for x in batch]
            yield struct(
                {
                    "lang": pa.array([x[0] for x in found], pa.string()),
                    "score": pa.array([x[1] for x in found], pa.float64()),
                }
            )

    return answer(raw(docs[text]))
