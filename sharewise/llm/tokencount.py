"""Token counts of whole texts without tokenizing whole texts.

For a vocabulary whose words never reach across a space, a text has as many tokens as its
pre-tokens (what stands between spaces and line feeds) have together. How many a pre-token has
is looked up in two tiers, both inside the task that reads the text, so no pre-token of the
corpus is ever shuffled:

1. a compact hash table of the frequent pre-tokens' lengths, broadcast once: open addressing
   over three flat arrays, probed for all pre-tokens together that the second tier misses;
2. a cache of the worker process, asked first, which keeps from batch to batch what it had to
   look up or encode.

What both miss is encoded by the library that owns the vocabulary file: a pre-token of printable
ASCII and letters of Latin-1 part by part by its model, if the file cuts words as ``CUT_BY`` says, any
other by the whole library, in one call for many. The first tier only saves work: a count never depends on what is in it.

``frequent`` fills it. Every task goes over all its texts and keeps a summary of bounded size
(Misra-Gries: whatever is more frequent in the task than one in ``SUMMARY`` is in it); only the
summaries are added up, and the ``TABLE`` largest sums are taken.

Defined results: a null or empty text has no token; equal texts have equal counts, repeated
rows are repeated; ties among frequent pre-tokens go in their own order. A pre-token over
``LONGEST`` characters is in neither tier, so memory stays bounded whatever the text. Bytes that
are no UTF-8 count as U+FFFD. An empty table gives no row and an empty first tier. Columns
other than key and text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.packing import byte_signs
from sharewise.llm.text import decoded, raw

TABLE = 1 << 15
SUMMARY = 1 << 13
#: Characters of a pre-token that may be kept in a tier.
LONGEST = 64
CACHED = 400_000
#: Characters of a text that are cut into pre-tokens at once, and missed pre-tokens settled at once.
PIECE = 1 << 20
TOGETHER = 1 << 16
#: How a file makes parts of a text, and the same cut of lower-case ``PLAIN`` signs, which no sign
#: beside them changes.
CUT_BY = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
            "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-ÿ]+|[0-9]|[^a-z0-9ß-ÿ]+")


# --- pre-tokens ----------------------------------------------------------------------------


def pretokens(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a whole text, a bounded piece of it at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            found = [at for at in (text.find(" ", end), text.find("\n", end)) if at >= 0]
            end = min(found, default=len(text))
        words = text[start:end].replace("\n", " ").split(" ")
        yield [word for word in words if word]
        start = end


_LIBRARY: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a file, loaded once a process; it neither cuts nor fills up texts."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LIBRARY[path] = made
    return _LIBRARY[path]


def lengths_of(words: list[str], path: str) -> list[int]:
    return [len(e) for e in library(path).encode_batch_fast(words, add_special_tokens=False)]


class Parts(NamedTuple):
    """What a worker knows of a file that cuts words as ``CUT_BY``: the words that ``PARTS`` cuts
    like it, how their letters are written there, and the lengths of parts met so far."""

    cut: re.Pattern
    signs: dict[int, str]
    lengths: dict[str, int]


_PARTS: dict[str, Parts | None] = {}


def parts_of(path: str) -> Parts | None:
    """None for a file that cuts words in another way."""
    if path not in _PARTS:
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        added = {token["content"][:1] for token in known.get("added_tokens") or []}
        alike = (known["normalizer"], known["pre_tokenizer"]) == CUT_BY and "" not in added
        model = known["model"]
        if alike and model["type"] == "BPE" and not model.get("dropout"):
            plain = "".join(c for c in PLAIN if c not in added)  # no added token begins in them
            of = {byte: sign for sign, byte in byte_signs().items()}
            signs = {ord(c): "".join(of[b] for b in c.encode()) for c in PLAIN}
            _PARTS[path] = Parts(re.compile(f"[{re.escape(plain)}]+"), signs, {})
        else:
            _PARTS[path] = None
    return _PARTS[path]


def lengths_by_parts(words: list[str], path: str) -> list[int]:
    """``lengths_of``; the words whose parts can be told here are cut here."""
    parts = parts_of(path)
    if parts is None:
        return lengths_of(words, path)
    cut, signs, known = parts
    if len(known) > CACHED:
        known.clear()
    tokenize = library(path).model.tokenize
    out, others = [0] * len(words), []
    for at, word in enumerate(words):
        if cut.fullmatch(word) is None:
            others.append(at)
            continue
        total = 0
        for part in PARTS.findall(word.lower()):
            if (n := known.get(part)) is None:
                n = len(tokenize(part if part.isascii() else part.translate(signs)))
                if len(part) <= LONGEST:
                    known[part] = n
            total += n
        out[at] = total
    if others:
        for at, n in zip(others, lengths_of([words[at] for at in others], path), strict=True):
            out[at] = n
    return out


def check(path: str) -> None:
    """Stop for a vocabulary whose tokens depend on the space before a word."""
    probes = ["a", "The", "word,", "12", "'s", "é", "́x", "語"]
    for one in probes:
        for other in probes:
            for space in (" ", "\n", "  "):
                parts = sum(lengths_of([one, other], path))
                if lengths_of([one + space + other], path) != [parts]:
                    raise ValueError(f"{path}: tokens of {other!r} depend on the space before it")


# --- the first tier ------------------------------------------------------------------------


class LengthTable(NamedTuple):
    """Open addressing: two halves of a 128-bit hash and the number of tokens, 0 if free."""

    high: np.ndarray
    low: np.ndarray
    tokens: np.ndarray

    @classmethod
    def build(cls, words: list[str], lengths: list[int]) -> LengthTable:
        size = 1 << max(1, 2 * len(words)).bit_length()
        table = cls(np.zeros(size, "<u8"), np.zeros(size, "<u8"), np.zeros(size, "<u4"))
        for (high, low), n in zip(hashes(words).tolist(), lengths, strict=True):
            at = low & (size - 1)
            while table.tokens[at] and (table.high[at], table.low[at]) != (high, low):
                at = (at + 1) & (size - 1)
            table.high[at], table.low[at], table.tokens[at] = high, low, n
        return table

    def find(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word, 0 for one that is not held."""
        out = np.zeros(len(words), np.int64)
        code = hashes(words)
        mask = np.uint64(len(self.tokens) - 1)
        open_, at = np.arange(len(words)), code[:, 1] & mask
        while len(open_):
            held = self.tokens[at]
            same = (self.high[at] == code[open_, 0]) & (self.low[at] == code[open_, 1])
            hit = same & (held > 0)
            out[open_[hit]] = held[hit]
            on = ~same & (held > 0)
            open_, at = open_[on], (at[on] + np.uint64(1)) & mask
        return out


def hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    data = b"".join([digest(word.encode("utf-8", "replace")) for word in words])
    return np.frombuffer(data, ">u8").astype("<u8").reshape(len(words), 2)


def add(summary: Counter, words: Iterable[str], size: int = SUMMARY) -> None:
    """Misra-Gries: count on, and once there are four times ``size`` words take the count of
    the ``size``-th largest from all of them."""
    summary.update(words)
    if len(summary) > 4 * size:
        counts = np.fromiter(summary.values(), np.int64, len(summary))
        floor = int(np.partition(counts, -size - 1)[-size - 1])
        kept = {word: n - floor for word, n in summary.items() if n > floor}
        summary.clear()
        dict.update(summary, kept)


def frequent(
    docs: DataFrame, path: str, text: str = "text", size: int = TABLE, summary: int = SUMMARY
) -> LengthTable:
    """The lengths of (about) the ``size`` most frequent pre-tokens of all texts."""
    check(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value in batch["text"]:
                for words in pretokens(decoded(value.as_py())):
                    if len(max(words, key=len, default="")) > LONGEST:
                        words = [w for w in words if len(w) <= LONGEST]
                    add(found, words, summary)
        top = found.most_common(summary)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["word", "n"],
        )

    rows = docs.select(raw(text).alias("text")).mapInArrow(count, "word string, n bigint")
    sums = rows.groupBy("word").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    words = top["word"].to_pylist()
    pairs = [(w, n) for w, n in zip(words, lengths_of(words, path), strict=True) if n]
    return LengthTable.build([w for w, _ in pairs], [n for _, n in pairs])


# --- both tiers ----------------------------------------------------------------------------

#: The second tier of this worker process, by file.
_CACHES: dict[str, dict[str, int]] = {}


def resolve(words: list[str], table: LengthTable, path: str) -> dict[str, int]:
    """The lengths of distinct pre-tokens that the cache misses: from the table, and else the
    library. Short ones are cached."""
    known = _CACHES.setdefault(path, {})
    if len(known) > CACHED:
        known.clear()
    short = [w for w in words if len(w) <= LONGEST]
    out = {w: n for w, n in zip(short, table.find(short).tolist(), strict=True) if n}
    missed = [w for w in words if w not in out]
    out.update(zip(missed, lengths_by_parts(missed, path), strict=True))
    known.update((w, out[w]) for w in short)
    return out


def count_texts(texts: Iterable[str], table: LengthTable, path: str) -> list[int]:
    """Tokens of each text; the pre-tokens that the cache misses are looked up together."""
    known = _CACHES.setdefault(path, {})
    totals: list[int] = []
    waiting: list[tuple[int, list[str]]] = []
    held = 0

    def settle() -> None:
        found = resolve(list(set().union(*(words for _, words in waiting))), table, path)
        for at, words in waiting:
            totals[at] += sum(map(found.__getitem__, words))
        waiting.clear()

    for text in texts:
        totals.append(0)
        for words in pretokens(text):
            lengths = list(map(known.get, words))
            if None in lengths:
                missed = [w for w, n in zip(words, lengths, strict=True) if n is None]
                waiting.append((len(totals) - 1, missed))
                held += len(missed)
                lengths = filter(None, lengths)
            totals[-1] += sum(lengths)
            if held >= TOGETHER:
                settle()
                held = 0
    settle()
    return totals


def token_counts(docs: DataFrame, table: LengthTable, path: str, text: str = "text") -> Column:
    """The number of tokens for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = (decoded(x.as_py()) for x in batch)
            yield pa.array(count_texts(texts, shared.value, path), pa.int64())

    return counted(raw(docs[text]))
