"""Quality rules: how far a text's letters and common words are from its language's.

For each language the corpus gives two reference histograms: classes of characters, and the
words that make up at least ``COMMON`` of the language's words (hence at most ``1 / COMMON`` of
them), with one bin for all other words. A text is compared with each language's by the
Jensen-Shannon distance (base 2, 0 to 1); the language whose worse distance is least counts.
Counting the references is a Spark aggregate over every text.

Base figures and verdict of a text:
``n_words`` words between ASCII white space; ``word_chars`` their code points; ``n_symbols``
characters of ``#*$%&|<>``; ``n_dup_lines`` lines with a word that equal an earlier line;
``n_repeat_words`` words inside three-word windows that occur twice or more;
``base_failed`` fewer than 50 words, or more than half of them repeated;
``kept`` not failed and both distances within their limits.

Defined results: a null text is an empty one, with no word, and fails. Texts too short to have
a histogram (``MIN_WORDS``) are never judged by divergence, nor is any text while there is no
reference. Rows without a language teach nothing, nor do languages beyond the ``MOST_LANGUAGES``
with the most words; repeated rows count each time they occur. An empty table gives no row and
no reference. ``CHAR_LIMIT`` and ``WORD_LIMIT`` are constants, set by hand between clean and junk
texts of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.text import raw, struct

MIN_WORDS = 50
COMMON = 0.002
CHAR_LIMIT = 0.31
WORD_LIMIT = 0.5
#: The languages that are referred to at most: those with the most words.
MOST_LANGUAGES = 200
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Words are flushed to Spark's aggregate whenever a task holds so many different ones.
DISTINCT_IN_TASK = 200_000
ANSWER = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,base_failed:boolean,char_distance:double,word_distance:double,"
    "language:string,kept:boolean>"
)


def _classes() -> np.ndarray:
    """Each byte's character class; what a character has after its first byte is class 0."""
    table = np.zeros(256, np.int64)
    groups = [
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SPACES,
        b".,;:!?'\"()-", SYMBOLS, b"@/\\=+_~^`[]{}", bytes(range(0xC2, 0xD0)),
        bytes(range(0xD0, 0xE0)), bytes(range(0xE0, 0xF0)), bytes(range(0xF0, 0xF8)),
    ]
    for number, group in enumerate(groups, 1):
        table[list(group)] = number
    return table


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


class Reference(NamedTuple):
    languages: list[str]
    chars: np.ndarray
    """A row per language: shares of the character classes."""
    words: list[dict[bytes, int]]
    shares: list[np.ndarray]
    """Per language the shares of its common words, and last of all others."""


def char_histogram(text: bytes) -> np.ndarray:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(CLASSES, weights=counts, minlength=N_CLASSES)[1:]


def _word(token: bytes) -> bytes:
    return token.lower().strip(b".,;:!?'\"()")


def references(
    docs: DataFrame, text: str = "text", lang: str = "lang", common: float = COMMON
) -> Reference:
    """Histograms of every language in ``docs``, over all its texts.

    Collected are a row per language and its common words, bounded by ``1 / common`` each.
    """
    rows = docs.select(F.col(lang).alias("lang"), raw(text).alias("text"))
    rows = rows.filter("lang is not null and text is not null")

    def table(word_rows: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
        columns = list(zip(*word_rows, strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.binary(), pa.int64())
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[bytes]] = {}
        chars: dict[str, np.ndarray] = {}

        def rows_of() -> list[tuple[str, bytes, int]]:
            return [(name, w, n) for name, seen in words.items() for w, n in seen.items()]

        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                value = value.as_py()
                seen = words.setdefault(name, Counter())
                tokens = value.lower().split()
                seen.update(tokens)
                chars[name] = chars.get(name, 0) + char_histogram(value)
                if len(seen) > DISTINCT_IN_TASK:
                    yield table(rows_of())
                    words.clear()
        # A class stands in the word column as a space and its number: no word has a space.
        marks = [
            (name, b" %d" % k, int(n)) for name, hist in chars.items() for k, n in enumerate(hist)
        ]
        yield table(rows_of() + marks)

    counts = (
        rows.mapInArrow(count, "lang string, word binary, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    is_class = F.substring("word", 1, 1) == F.lit(b" ")
    # Words at the end of a clause count as the same word.
    bare = F.when(is_class, F.col("word").cast("string")).otherwise(
        F.regexp_replace(F.col("word").cast("string"), r"^[.,;:!?'\"()]+|[.,;:!?'\"()]+$", "")
    )
    bare_counts = counts.groupBy("lang", bare.alias("word")).agg(F.sum("n").alias("n")).persist()
    is_word = ~F.col("word").startswith(" ")
    sizes = bare_counts.filter(is_word).groupBy("lang").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    totals = {r["lang"]: r["n"] for r in most.collect()}
    kept = ~is_word
    for name, n in totals.items():
        kept = kept | ((F.col("lang") == name) & (F.col("n") >= common * n))
    found = bare_counts.filter(F.col("lang").isin(list(totals)) & kept).collect()
    bare_counts.unpersist()
    names = sorted({r["lang"] for r in found})
    chars = np.zeros((len(names), N_CLASSES - 1))
    words: list[dict[bytes, int]] = [{} for _ in names]
    sums: list[list[float]] = [[] for _ in names]
    for r in sorted(found, key=lambda r: (r["lang"], r["word"])):
        at = names.index(r["lang"])
        if r["word"].startswith(" "):
            chars[at, int(r["word"])] = r["n"]
        elif r["word"]:
            words[at][r["word"].encode()] = len(sums[at])
            sums[at].append(r["n"])
    shares = [
        np.array([*s, max(0, totals.get(name, 0) - sum(s))]) / max(1, totals.get(name, 0))
        for name, s in zip(names, sums, strict=True)
    ]
    return Reference(names, chars / np.maximum(1, chars.sum(axis=1, keepdims=True)), words, shares)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that each sum to 1."""
    mid = (p + q) / 2

    def against(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / mid[some])).sum())

    return max(0.0, (against(p) + against(q)) / 2) ** 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    pairs = ids[:-2] * len(code) + ids[1:-1]
    if len(code) > 2_000_000:  # else the cube of the number of words fits 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs * len(code) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: bytes | None, reference: Reference) -> tuple:
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    starts = int(counts[:0x80].sum() + counts[0xC0:].sum())
    n_symbols = int(counts[list(SYMBOLS)].sum())
    word_chars = starts - int(counts[list(SPACES)].sum())
    seen: set[bytes] = set()
    doubled = 0
    for line in text.split(b"\n"):
        if line.strip():
            doubled += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    best = (0.0, 0.0, None)
    if n >= MIN_WORDS and reference.languages:
        chars = np.bincount(CLASSES, weights=counts, minlength=N_CLASSES)[1:]
        chars = chars / max(1.0, chars.sum())
        tokens = Counter(map(_word, words))
        found = []
        for k, name in enumerate(reference.languages):
            own = np.zeros(len(reference.shares[k]))
            for word, at in reference.words[k].items():
                own[at] = tokens.get(word, 0)
            own[-1] = n - own[:-1].sum()
            pair = distance(chars, reference.chars[k]), distance(own / n, reference.shares[k])
            found.append((max(pair[0] / CHAR_LIMIT, pair[1] / WORD_LIMIT), name, *pair))
        worst, name, by_chars, by_words = min(found)
        best = by_chars, by_words, name
    kept = not failed and best[0] <= CHAR_LIMIT and best[1] <= WORD_LIMIT
    return n, word_chars, n_symbols, doubled, repeats, failed, *best, kept


def judge(docs: DataFrame, reference: Reference, text: str = "text") -> Column:
    """A struct of base figures, distances and the verdict for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(reference)
    fields = [part.split(":") for part in ANSWER[7:-1].split(",")]
    kinds = {
        "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()
    }

    @F.arrow_udf(ANSWER)
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [measure(x.as_py(), shared.value) for x in batch]
            yield struct(
                {
                    name: pa.array([row[i] for row in found], kinds[kind])
                    for i, (name, kind) in enumerate(fields)
                }
            )

    return answer(raw(docs[text]))
