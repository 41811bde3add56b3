"""Whole texts inside a task, and the split of a labelled table into learnt and held-out rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HELD_OUT = 2
_LETTER: list[np.ndarray] = []


def raw(text: Column | str) -> Column:
    """A text as its bytes, so that invalid UTF-8 reaches a task as it is."""
    return F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")


def decoded(value: bytes | None) -> str:
    """Null is the empty text; bytes that are not UTF-8 become U+FFFD."""
    return "" if value is None else value.decode("utf-8", "replace")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    code = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(code == HELD_OUT, F.lit(False))


def codes(text: str) -> np.ndarray:
    """The text's code points; a lone surrogate counts as U+FFFD."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    if not _LETTER:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTER.append(table)
    return _LETTER[0]


def pieces(text: str, size: int, overlap: int) -> Iterator[str]:
    """The whole text in pieces of at most ``size`` new characters, each with the last
    ``overlap`` characters of the one before, so that memory stays bounded."""
    for start in range(0, max(1, len(text)), size):
        yield text[max(0, start - overlap) : start + size]


def struct(arrays: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays))
