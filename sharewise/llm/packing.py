"""Packing: vector bins under limits on tokens, segments and loss-bearing tokens.

A bin is filled by the dot-product heuristic: of the examples that still fit under every limit
the one is placed whose demand (as shares of the limits) has the largest inner product with
what the bin has left. Examples wait in a pool of bounded size; a task packs what it reads, so
nothing is shuffled and no task sees more than its own rows. Texts may be cut: what is longer
than a sequence fills whole sequences, and a waiting example is cut to close a bin without
padding. With ``divisible=False`` examples stay whole, and one over a limit is an error.

Defined results: a null text is an empty one; each text ends with ``end_id``, so an empty one
has that token alone. Rows with the same id are packed one after the other, each from start 0.
An empty table has no piece. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sharewise.llm.text import decoded, raw

CAPACITY = 1024
MAX_SEGMENTS = 512
POOL = 2048
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, loss_tokens bigint"
)


class Limits(NamedTuple):
    tokens: int = CAPACITY
    segments: int = MAX_SEGMENTS
    loss: int = CAPACITY


# --- tokens --------------------------------------------------------------------------------


def byte_signs() -> dict[str, int]:
    """The printable sign by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return signs | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """Ids of whole texts by the vocabulary in a ``tokenizers`` file, as little-endian uint32.

    A text is encoded in one call that returns its ids as an array: no word is kept, as in prose
    with many rare words looking words up costs more than encoding them. The file's added tokens
    are one id each wherever they stand in a text, as its library has it.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        vocabulary, added = known["model"]["vocab"], {}
        for token in known.get("added_tokens") or []:
            loose = token["lstrip"] or token["rstrip"] or token["single_word"]
            if loose or any(c.isspace() for c in token["content"]):
                raise ValueError(f"{path}: {token['content']!r} takes signs beside it")
            added[token["content"]] = token["id"]
        signs = byte_signs()
        ranks = {
            bytes(signs[s] for s in token): rank
            for token, rank in vocabulary.items()
            if token not in added and all(s in signs for s in token)
        }
        self.words = tiktoken.Encoding(
            "words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added
        )
        self.added = set(added)

    def ids(self, text: str) -> bytes:
        found = self.words.encode_to_numpy(
            text, allowed_special=self.added, disallowed_special=()
        )
        return found.astype("<u4", copy=False).tobytes()


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of this worker process, loaded once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


# --- bins ----------------------------------------------------------------------------------


class Piece(NamedTuple):
    key: object
    start: int
    length: int
    loss: int
    total: int
    ids: bytes


class Packer:
    """Bins from a stream of examples; a closed bin is a list of pieces."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL, divisible: bool = True):
        self.limits, self.divisible, self.size = limits, divisible, pool
        self.items: list[Piece] = []
        self.demand = np.zeros((2, pool + 2))  # tokens and loss; each takes one segment

    def _wait(self, piece: Piece) -> None:
        if len(self.items) >= self.demand.shape[1]:
            self.demand = np.hstack([self.demand, np.zeros_like(self.demand)])
        self.demand[:, len(self.items)] = piece.length, piece.loss
        self.items.append(piece)

    def _take(self, at: int) -> Piece:
        piece, last = self.items[at], self.items.pop()
        if at < len(self.items):
            self.items[at] = last
            self.demand[:, at] = self.demand[:, len(self.items)]
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take an example in; yields the bins that it closes."""
        tokens, _, loss = self.limits
        if not self.divisible and (piece.length > tokens or piece.loss > loss):
            raise ValueError(f"example {piece.key!r} is over a limit")
        while self.divisible and (piece.length >= tokens or piece.loss > loss):
            head, piece = self._cut(piece, min(tokens, loss if piece.loss else tokens))
            yield [head]
        if piece.length:
            self._wait(piece)
        while len(self.items) > self.size:
            yield self._fill()

    def flush(self) -> Iterator[list[Piece]]:
        while self.items:
            yield self._fill()

    def _cut(self, piece: Piece, at: int) -> tuple[Piece, Piece]:
        """Texts bear loss on every token or on none."""
        head = piece._replace(length=at, loss=at if piece.loss else 0, ids=piece.ids[: 4 * at])
        rest = piece.length - at
        tail = piece._replace(
            start=piece.start + at, length=rest, loss=rest if piece.loss else 0,
            ids=piece.ids[4 * at :],
        )
        return head, tail

    def _fill(self) -> list[Piece]:
        left, bin_ = [float(limit) for limit in self.limits], []
        while self.items and left[0] >= 1 and left[1] >= 1:
            tokens, loss = self.demand[:, : len(self.items)]
            by_token, by_segment, by_loss = (
                room / limit**2 for room, limit in zip(left, self.limits, strict=True)
            )
            gain = tokens * by_token
            gain += by_segment
            gain += loss * by_loss
            gain[tokens > left[0]] = -1.0
            gain[loss > left[2]] = -1.0
            at = int(gain.argmax())
            if gain[at] >= 0:
                piece = self._take(at)
            elif self.divisible and (room := int(min(left[0], left[2]))) >= 1:
                piece, rest = self._cut(self._take(int(tokens.argmax())), room)
                self._wait(rest)
            else:
                break
            bin_.append(piece)
            for kind, used in enumerate((piece.length, 1, piece.loss)):
                left[kind] -= used
        return bin_


# --- whole tables --------------------------------------------------------------------------


def pack_texts(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    limits: Limits = Limits(),
    end_id: int = 0,
    pool: int = POOL,
) -> DataFrame:
    """A row per piece of every text: where it starts and ends, and its place in a sequence.

    Every token of a document bears loss, the end token too. A sequence's number carries the
    number of the task's partition, so tasks need not agree on anything.
    """
    kind = docs.schema[key].dataType.simpleString()
    key_type = to_arrow_type(docs.schema[key].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = tokenizer(tokenizer_path), Packer(limits, pool)
        end = np.array([end_id], "<u4").tobytes()

        def bins() -> Iterator[list[Piece]]:
            for batch in batches:
                for name, value in zip(batch["key"], batch["text"], strict=True):
                    ids = words.ids(decoded(value.as_py())) + end
                    n = len(ids) // 4
                    yield from packer.add(Piece(name.as_py(), 0, n, n, n, ids))
            yield from packer.flush()

        yield from _numbered(bins(), key, key_type)

    rows = docs.select(F.col(key).alias("key"), raw(text).alias("text"))
    return rows.mapInArrow(pack, f"{key} {kind}, {SCHEMA}")


def pack_examples(
    examples: DataFrame,
    key: str = "example_id",
    tokens: str = "n_tokens",
    loss: str = "n_loss",
    limits: Limits = Limits(),
    pool: int = POOL,
) -> DataFrame:
    """Instruction examples kept whole: a row per example with its sequence and offset.

    Null counts are zero; an example without a token has no row.
    """
    kind = examples.schema[key].dataType.simpleString()
    key_type = to_arrow_type(examples.schema[key].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, pool, divisible=False)

        def bins() -> Iterator[list[Piece]]:
            for batch in batches:
                columns = (batch[c].to_pylist() for c in ("key", "n", "loss"))
                for name, n, bearing in zip(*columns, strict=True):
                    yield from packer.add(Piece(name, 0, n, bearing, n, b""))
            yield from packer.flush()

        yield from _numbered(bins(), key, key_type)

    rows = examples.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.col(loss), F.lit(0)).cast("bigint").alias("loss"),
    )
    out = rows.mapInArrow(pack, f"{key} {kind}, {SCHEMA}")
    return out.drop("start", "ids_crc32", "doc_tokens")


def _numbered(
    bins: Iterable[list[Piece]], key: str, key_type: pa.DataType
) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    for number, pieces in enumerate(bins):
        offset = 0
        for p in pieces:
            crc = zlib.crc32(p.ids)
            rows.append((p.key, p.start, p.length, crc, p.total, base + number, offset, p.loss))
            offset += p.length
        if len(rows) >= 10_000:
            yield _batch(rows, key, key_type)
            rows = []
    if rows:
        yield _batch(rows, key, key_type)


def _batch(rows: list[tuple], key: str, key_type: pa.DataType) -> pa.RecordBatch:
    names = [key, *(part.split(" ")[0] for part in SCHEMA.split(", "))]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
    return pa.RecordBatch.from_arrays(arrays, names=names)
