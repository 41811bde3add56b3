"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Folding lower-cases, maps look-alike letters and digits written for letters to Latin ones,
drops invisible characters and turns everything else into single spaces. A pattern is a whole
word or the beginning of a word. A word scores the largest weight among the patterns that match
it, unless it lies in an exception phrase; the sum is divided by the number of words, and
``1 - exp(-rate * that)`` is the score.

The lexicon is learnt from labelled rows (about ``SAMPLE`` of them, the one bound of the fit): words and word beginnings that come with many
different neighbours in toxic texts and hardly ever in others (neighbours, so that copies of
one toxic text do not promote its ordinary words).

Defined results: null and empty texts score 0; without labelled toxic rows the lexicon is empty
and every score is 0. Repeated rows score alike, an empty table gives no row. Of patterns that
match at one place the heaviest counts, so ties do not matter. The answer is one double column, so columns of
any name may stand beside it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.text import codes, decoded, letter_table, pieces, raw
from sharewise.session import stage

THRESHOLD = 0.3
SAMPLE = 20_000
STEMS = (4, 5, 6, 7)
PIECE = 1 << 18
LEAST_ODDS = 20
#: Occurrences in other texts that a sample without any leaves possible.
UNSEEN = 1
#: What a sign written for a letter stands for.
LOOKALIKES = {
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j",
    "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a",
    "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Signs without width, which are left out.
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases in which a listed word does not count.
EXCEPTIONS = (
    "trash can", "trash bin", "recycle the trash", "take out the trash", "clown fish",
    "circus clown", "pond scum", "sore loser", "worthless check", "stupid question",
)
_FOLD: list[np.ndarray] = []


class Lexicon(NamedTuple):
    """``patterns``: folded pattern with a leading space (and a trailing one for a whole word)
    to weight."""

    patterns: dict[str, float]
    rate: float
    exceptions: tuple[str, ...] = EXCEPTIONS


def _fold_table() -> np.ndarray:
    if not _FOLD:
        table = letter_table().copy()
        for sign in range(0xFF01, 0xFF5F):  # full-width forms of ASCII
            table[sign] = table[sign - 0xFEE0]
        for sign, letter in LOOKALIKES.items():
            for form in {sign, sign.upper()}:
                if len(form) == 1:
                    table[ord(form)] = ord(letter)
        for sign in range(0x300, 0x110000):  # marks on a letter before them
            if unicodedata.category(chr(sign)) in ("Mn", "Me"):
                table[sign] = 0
        for sign in INVISIBLE:
            table[ord(sign)] = 0
        _FOLD.append(table)
    return _FOLD[0]


def fold(text: str) -> str:
    """The folded text, with one space before, between and after the words.

    Combining marks are left out; a letter that is one sign with its mark keeps it. Marks that
    often end a sentence (``!`` and ``|``) stand for letters only inside a word.
    """
    found = codes(text)
    chars = _fold_table()[found]
    if (loose := np.isin(found, (33, 124))).any():
        after = np.append(letter_table()[found][1:], np.uint32(32))
        chars = np.where(loose & (after == 32), np.uint32(32), chars)
    chars = chars[chars != 0]
    keep = chars != 32
    keep[1:] |= chars[:-1] != 32
    return f" {chars[keep].tobytes().decode('utf-32-le').strip()} "


def _parts(text: str) -> Iterator[str]:
    """The whole text in bounded pieces that end between words."""
    if len(text) <= PIECE:
        yield fold(text)
        return
    rest = ""
    for part in pieces(text, PIECE, 0):
        part = rest + part
        cut = max(part.rfind(" "), part.rfind("\n"))
        # A word longer than a piece is scored in pieces.
        cut = len(part) if cut < 0 else cut
        yield fold(part[:cut])
        rest = part[cut:]
    yield fold(rest)


def automaton(lexicon: Lexicon):
    """All patterns in one Aho-Corasick automaton; None for an empty lexicon."""
    import ahocorasick

    if not lexicon.patterns:
        return None
    machine = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        machine.add_word(fold(phrase), (len(fold(phrase)), 0.0))
    for pattern, weight in lexicon.patterns.items():
        machine.add_word(pattern, (len(pattern), weight))
    machine.make_automaton()
    return machine


def density(text: str, machine) -> float:
    """Weight of the matched words for each word of the text."""
    if machine is None:
        return 0.0
    total, words = 0.0, 0
    for folded in _parts(text):
        words += folded.count(" ") - 1 if folded != "  " else 0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in machine.iter(folded):
            start = end - length + 1
            if weight:
                best[start] = max(weight, best.get(start, 0.0))
            else:
                spared.append((start, end))
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        total += sum(best.values())
    return total / words if words else 0.0


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> Column:
    """The score of each row of ``docs``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine, rate = automaton(shared.value), shared.value.rate
        for batch in batches:
            found = [density(decoded(x.as_py()), machine) for x in batch]
            yield pa.array([-math.expm1(-rate * x) for x in found], pa.float64())

    return answer(raw(docs[text]))


def features(word: str) -> list[str]:
    """The patterns under which a word can be listed."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)]


def _contexts(texts: Iterable[str]) -> set[tuple[str, int]]:
    """Each pattern with a code of the words around it, once."""
    import xxhash

    out = set()
    for text in texts:
        for folded in _parts(text):
            words = folded.split()
            around = zip(["", *words], words, [*words[1:], ""], strict=False)
            for before, word, after in around:
                code = xxhash.xxh32_intdigest(f"{before} {after}")
                out.update((pattern, code) for pattern in features(word))
    return out


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _toxic_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            found = list(_contexts(decoded(x.as_py()) for x in part["text"]))
            yield _table(
                {
                    "pattern": pa.array([x[0] for x in found], pa.string()),
                    "around": pa.array([x[1] for x in found], pa.int64()),
                }
            )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
    min_share: float = 0.01,
    min_contexts: int = 6,
) -> Lexicon:
    """Learn the lexicon from about ``sample`` labelled rows (the documented bound).

    A pattern is listed if at least ``min_contexts`` different neighbourhoods, and a
    ``min_share`` of as many as there are toxic texts, hold it in toxic texts, and it is there
    ``LEAST_ODDS`` times as frequent as in others. Rows are taken by a hash of the key.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    marked = marked.dropna().distinct()
    total = marked.count()
    fine = 1 << 20
    if total > sample:
        marked = marked.filter(F.pmod(F.xxhash64("key"), F.lit(fine)) < fine * sample // total)
    rows = docs.select(F.col(key).alias("key"), raw(text).alias("text")).join(
        F.broadcast(marked), "key"  # about ``sample`` narrow rows
    )
    rows = stage(rows.filter("text is not null").select("text", "label"), "toxicity-sample")
    toxic = rows.filter("label = 1")
    n_toxic = toxic.count()
    if not n_toxic:
        return Lexicon({}, 0.0)
    least = max(min_contexts, math.ceil(min_share * n_toxic))
    found = (
        toxic.mapInArrow(_toxic_contexts, "pattern string, around bigint")
        .distinct()
        .groupBy("pattern")
        .count()
        .filter(F.col("count") >= least)
        .collect()  # words of the learning sample
    )
    listed = {row["pattern"]: row["count"] for row in found}
    names = docs.sparkSession.sparkContext.broadcast(set(listed))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch["text"]:
                for folded in _parts(decoded(value.as_py())):
                    for word in folded.split():
                        counts.update(x for x in features(word) if x in names.value)
        numbers = pa.array(list(counts.values()), pa.int64())
        yield _table({"pattern": pa.array(list(counts), pa.string()), "n": numbers})

    clean = {
        row["pattern"]: row["n"]
        for row in rows.filter("label <> 1")
        .mapInArrow(clean_counts, "pattern string, n bigint")
        .groupBy("pattern")
        .agg(F.sum("n").alias("n"))
        .collect()
    }
    sizes = dict(rows.groupBy(F.col("label") == 1).agg(F.sum(F.length("text"))).collect())
    more_clean = sizes.get(False, 0) / max(1, sizes[True])  # as many bytes as toxic ones
    weights = {}
    for pattern, contexts in listed.items():
        odds = contexts * more_clean / (clean.get(pattern, 0) + UNSEEN)
        if odds >= LEAST_ODDS:
            weights[pattern] = min(1.0, math.log(odds) / math.log(50 * LEAST_ODDS))
    kept = dict(sorted(_pruned(weights, listed).items()))
    return Lexicon(kept, _rate(rows, kept))


def _pruned(weights: dict[str, float], contexts: dict[str, int]) -> dict[str, float]:
    """Without beginnings that stand for one longer pattern only, and without patterns of which
    a remaining beginning weighs as much."""

    def beginnings(pattern: str) -> list[str]:
        return [pattern[: n + 1] for n in STEMS if n + 1 < len(pattern)]

    narrow = {
        b for p in weights for b in beginnings(p) if 10 * contexts[p] >= 9 * contexts.get(b, 0)
    }
    wide = {p: w for p, w in weights.items() if p not in narrow}
    return {p: w for p, w in wide.items() if not any(wide.get(b, 0) >= w for b in beginnings(p))}


def _rate(rows: DataFrame, patterns: dict[str, float]) -> float:
    """The rate with which the score passes the threshold where toxic rows begin.

    The cut is the density with the best F1 on the learning sample, placed (geometrically) in
    the middle between the last density below and the first above.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Lexicon(patterns, 1.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            found = [density(decoded(x.as_py()), machine) for x in batch["text"]]
            yield _table({"label": batch["label"], "density": pa.array(found, pa.float64())})

    seen = rows.select("text", "label").mapInArrow(measure, "label int, density double").toArrow()
    value, label = seen["density"].to_numpy(), seen["label"].to_numpy() == 1
    order = np.argsort(-value, kind="stable")
    value, hits = value[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(value) + 1) + max(1, label.sum()))
    ends = np.append(value[1:] != value[:-1], True) & (value > 0)
    if not ends.any():
        return 1.0
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = value[best + 1] if best + 1 < len(value) else 0.0
    cut = math.sqrt(value[best] * below) if below > 0 else value[best] / 2
    return -math.log1p(-THRESHOLD) / cut
