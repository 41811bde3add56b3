"""Fill-in-middle: each text cut between two of its lines into prefix, middle and suffix, and
put together again in an order in which the middle comes last.

Where to cut is found in SWAR words. The UTF-8 bytes of many texts are viewed as ``uint64``; a
few additions and masks mark in each word the bytes that end a unit (a line) and, in a second
mask, the bytes that continue a character. ``bitwise_count`` gives the marks of each word, and
the word that holds the k-th line end is searched in their running sum; inside the word the
lowest marks are cleared one by one. No text is decoded and no line becomes a Python object.
Everything else - the draws from a digest of the id, the choice of the form, the output - is
done by DataFrame functions, without a shuffle.

Defined results: a null text is an empty one; an empty text, one that holds a sentinel and one
that the draw leaves out are ``plain``: the output is the text, the character counts are null.
A null id draws from the empty string in its place. Rows with equal id and text get equal
output, rows with equal id and different texts draw the same numbers. Bytes that are no UTF-8
stay as they are, and count as characters unless they look like continuing bytes. An empty
table gives no row. Columns other than the id and the text are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.text import raw, struct

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Texts are viewed together up to so many bytes; a longer one is viewed alone.
BLOCK = 1 << 23

_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE = np.uint64(1)


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def check(sentinels: Sentinels) -> None:
    """Sentinels must differ, and none may end as one begins: a text that holds none then
    cannot make one together with a sentinel beside it."""
    for one in sentinels:
        for other in sentinels:
            if any(one.endswith(other[:k]) for k in range(1, len(other))) or not one:
                raise ValueError(f"{one!r} runs into {other!r}")
    if len(set(sentinels)) < len(sentinels):
        raise ValueError("sentinels must differ")


# --- words of eight bytes ------------------------------------------------------------------


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed.

    The sum stays below 256 in each byte, so nothing is carried into the next one and no byte
    is marked by mistake.
    """
    differ = words ^ _NEWLINES
    return ~(((differ & _LOW) + _LOW) | differ | _LOW)


def continuing(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte ``10xxxxxx``, which continues a character."""
    return words & ~(words << _ONE) & _HIGH


class Marks:
    """Marked bytes of a block: how many lie before a place, and where the k-th one lies."""

    def __init__(self, masks: np.ndarray):
        self.masks = masks
        self.before = np.zeros(len(masks) + 1, np.int64)
        np.cumsum(np.bitwise_count(masks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place; the block ends in a word without marks."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        low = self.masks[word] & ((_ONE << bits) - _ONE)
        return self.before[word] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th mark, from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        mask, left = self.masks[word], k - self.before[word]
        while (more := left > 1).any():
            mask = np.where(more, mask & (mask - _ONE), mask)
            left = left - more
        lowest = mask & (~mask + _ONE)
        return (word << 3) + (np.bitwise_count(lowest - _ONE).astype(np.int64) >> 3)


def cut_block(data: np.ndarray, bounds: np.ndarray, draw_1: np.ndarray, draw_2: np.ndarray):
    """For texts that lie one after the other in ``data``: the number of lines, and bytes and
    characters of prefix and middle. ``bounds`` has the start of each text and the last end."""
    words = np.zeros((len(data) >> 3) + 2, "<u8")
    words.view(np.uint8)[: len(data)] = data
    ends, inner = Marks(line_ends(words)), Marks(continuing(words))
    start, end = bounds[:-1], bounds[1:]
    first = ends.rank(start)
    feeds = ends.rank(end) - first
    filled = end > start
    last = words.view(np.uint8)[np.maximum(end - 1, 0)]
    n = feeds + (filled & (last != 10))

    def after(units: np.ndarray) -> np.ndarray:
        """The place behind so many lines; the last one may end without a line feed."""
        place = np.where(units > feeds, end, start)
        fed = (units > 0) & (units <= feeds)
        place[fed] = ends.select((first + units)[fed]) + 1
        return place

    def chars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b - a) - (inner.rank(b) - inner.rank(a))

    one, two = draw_1 % (n + 1), draw_2 % (n + 1)
    a, b = after(np.minimum(one, two)), after(np.maximum(one, two))
    return n, a - start, b - a, chars(start, a), chars(a, b)


def blocks(bounds: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``size`` bytes together, or of one longer text."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def cut_batch(texts: pa.Array, draw_1: np.ndarray, draw_2: np.ndarray) -> list[np.ndarray]:
    """``cut_block`` of a whole Arrow array, on its own bytes."""
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    parts = []
    for a, b in blocks(bounds):
        part = held[bounds[a] : bounds[b]]
        parts.append(cut_block(part, bounds[a : b + 1] - bounds[a], draw_1[a:b], draw_2[a:b]))
    if not parts:
        return [np.zeros(0, np.int64)] * 5
    return [np.concatenate(column) for column in zip(*parts, strict=True)]


# --- tables --------------------------------------------------------------------------------


def cuts(text: Column, draw_1: Column, draw_2: Column) -> Column:
    """A struct of ``n`` and the bytes and characters of prefix and middle."""
    names = ("n", "prefix", "middle", "prefix_chars", "middle_chars")

    @F.arrow_udf(f"struct<{','.join(f'{name}:bigint' for name in names)}>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, *draws in batches:
            found = cut_batch(texts, *(d.to_numpy(zero_copy_only=False) for d in draws))
            yield struct({k: pa.array(v, pa.int64()) for k, v in zip(names, found, strict=True)})

    return cut(text, draw_1, draw_2)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``seed:key``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    sentinels: Sentinels = Sentinels(),
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` for each row of ``docs``.

    Of a text's ``n`` lines the prefix takes as many as the smaller of two draws from 0 to n,
    prefix and middle together as many as the larger. ``percent`` of the ids are transformed,
    ``spm_percent`` of those have the suffix first.
    """
    check(sentinels)
    body = F.coalesce(F.col(text), F.lit(""))
    one, two, three, four = draws(F.col(key), seed)
    rows = docs.select(
        F.col(key).alias("key"), body.alias("body"), cuts(raw(body), one, two).alias("cut"),
        three.alias("three"), four.alias("four"),
    )
    held = (F.col("body") == "") | (F.col("three") % 100 >= percent)
    for sign in sentinels:
        held = held | F.contains(F.col("body"), F.lit(sign))
    spm = F.col("four") % 100 < spm_percent
    form = F.when(held, PLAIN).when(spm, SPM).otherwise(PSM)

    data, a, b = F.col("body").cast("binary"), F.col("cut.prefix"), F.col("cut.middle")

    def part(start, length):
        return F.substring(data, start.cast("int"), length.cast("int")).cast("string")

    prefix, middle = part(F.lit(1), a), part(a + 1, b)
    suffix = part(a + b + 1, F.octet_length("body") - a - b)
    p, s, m = (F.lit(x) for x in sentinels)
    output = (
        F.when(F.col("form") == PLAIN, F.col("body"))
        .when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    moved = F.col("form") != PLAIN
    return rows.withColumn("form", form).select(
        F.col("key").alias(key),
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, F.col("cut.prefix_chars")).alias("prefix_chars"),
        F.when(moved, F.col("cut.middle_chars")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` was made of.

    A transformed text holds no sentinel and cannot complete one (``check``), so each occurs
    once and parts the output exactly.
    """
    p, s, m = sentinels

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, m, -1)
    return (
        F.when(form == PSM, F.concat(between(p, s), middle, between(s, m)))
        .when(form == SPM, F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
