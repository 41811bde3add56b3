"""Exact removal of long repeated byte strings by hash-compared suffix sorting.

Removed is each byte covered by a string of ``length`` bytes (a window) that also starts
anywhere else in the table. Strings are judged on the input.

1. Every window has an anchor, its ``GRAM``-byte substring with the least hash, so equal windows
   have equal anchors at equal places. Neighbouring windows with one anchor make a *run*; a task
   computes runs from prefix polynomial hashes. Only runs whose anchor occurs twice go on.
2. Runs with the same bytes (128-bit digest) are one *content*; its windows all repeat.
3. Contents that share an anchor with other contents are compared. Their bytes are dealt by
   anchor into buckets; in a bucket, blocks of windows whose common core nobody shares are
   dropped, and the suffixes at the remaining windows are sorted by mergesort. A comparison
   finds the common extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours with ``length`` bytes in common, verified byte by byte, repeat.
   An anchor with more than ``HOT`` contents (an edge of a passage that half the corpus quotes)
   is not brought together: its blocks, and where blocks share a core but differ their windows,
   are counted by their 128-bit digests instead.
4. Repeated windows go back to the runs, runs to the texts.

Polynomial hashes are taken modulo 2**64. They are only ever used to find, never to accept.

Defined results: a null text is empty; texts shorter than a window lose nothing; repeated rows
repeat each other, so they lose what is long enough; rows sharing a key are told apart by their
texts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.text import raw, struct
from sharewise.session import stage

LENGTH = 200
GRAM = 50
CHUNK = 1 << 20
HOT = 1000
BLOCK = 8
#: Suffixes sorted together in a bucket's task.
BUCKET = 200_000
#: Odd base of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + LENGTH)
        _POWERS[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))])
            for x in (BASE, INVERSE)
        ]
    return _POWERS[0], _POWERS[1]


class PrefixHashes:
    """Hash of any substring of ``text`` in constant time."""

    def __init__(self, text: np.ndarray):
        power, self.inverse = _powers(len(text) + 1)
        values = (text.astype(np.uint64) + np.uint64(1)) * power[: len(text)]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]

    def each(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, from minima forwards and backwards in blocks."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def runs(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """First window, number of windows, place of the anchor after it and the anchor's hash, of
    every run; in chunks, so that long texts take bounded memory."""
    data = np.frombuffer(text, np.uint8)
    low = np.uint64((1 << 22) - 1)
    for begin in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        grams = _mixed(PrefixHashes(part).each(gram))
        places = np.arange(len(grams), dtype=np.uint64)
        least = _least((grams & ~low) | places, length - gram + 1)
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        yield begin + first, count, at - first, grams[at].view(np.int64)


def _digests(text: bytes, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    import xxhash

    view = memoryview(text)
    found = [
        xxhash.xxh3_128_digest(view[a : a + n - 1 + length])
        for a, n in zip(first.tolist(), count.tolist(), strict=True)
    ]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


#: A run's place in one number: its first window, number of windows, place of the anchor.
def _packed(first, count, anchor_at):
    return (first << 16) | (count << 8) | anchor_at



def _run_table(rows: DataFrame, key: str, length: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, code, value in zip(batch["id"], batch["code"], batch["text"], strict=True):
                text = value.as_py()
                if text is None or len(text) < length:
                    continue
                for first, count, at, anchor in runs(text, length, gram):
                    n, digest = len(first), _digests(text, first, count, length)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * n, name.type),
                            pa.array(np.full(n, code.as_py(), np.int64)),
                            pa.array(_packed(first, count, at).astype(np.int64)),
                            pa.array(anchor),
                            pa.array(digest[:, 0]),
                            pa.array(digest[:, 1]),
                        ],
                        names=["id", "code", "place", "anchor", "c1", "c2"],
                    )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        emit, f"id {kind}, code bigint, place bigint, anchor bigint, c1 bigint, c2 bigint"
    )


# --- sorting suffixes ----------------------------------------------------------------------


class SuffixOrder:
    """Comparisons of a text's suffixes up to ``depth`` bytes, many at once."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth, self.hash = text, depth, PrefixHashes(text)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.full(len(a), self.depth, np.int64)
        while (high > low).any():
            middle = (low + high + 1) >> 1
            same = self.hash(a, middle) == self.hash(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; equal ones keep their order (False)."""
        size = self.common(a, b)
        inside = size < self.depth
        step = np.where(inside, size, 0)
        return inside & (self.text[a + step] < self.text[b + step])

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """Mergesort: all merges of a level at once. Each suffix finds by binary search how many
        of the other half come before it."""
        order, n, width = starts.copy(), len(starts), 1
        place = np.arange(n)
        while width < n:
            half = place // width
            mine = half % 2
            other = np.where(mine == 0, (half + 1) * width, (half - 1) * width)
            low = np.minimum(other, n)
            high = np.minimum(other + width, n)
            begin = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                there, here = order[middle], order[open_]
                # From the left half only what is smaller counts, from the right half also ties.
                right = mine[open_] == 1
                ahead = np.where(right, ~self.before(here, there), self.before(there, here))
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            base = (half - mine) * width
            rank = base + (place - half * width) + (low - begin)
            merged = np.empty_like(order)
            merged[rank] = order
            order, width = merged, width * 2
        return order


def repeated_windows(
    contexts: list[bytes], first: np.ndarray, count: np.ndarray, at: np.ndarray,
    group: np.ndarray, length: int,
) -> list[np.ndarray]:
    """For each context which of its windows also start elsewhere among contexts of its group.

    Contexts are different; context i has ``count[i]`` windows and its anchor ``at[i]`` after
    the first (``first`` is where it starts in the joined bytes).
    """
    marks = [np.zeros(n, bool) for n in count.tolist()]
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order = SuffixOrder(text, length)
    owner = np.repeat(np.arange(len(contexts)), count)
    begin = np.repeat(np.cumsum(count) - count, count)
    number = np.arange(len(owner)) - begin
    start = first[owner] + number
    offset = at[owner] - number + 256  # of the anchor from the window; 256 keeps it positive
    block = offset // BLOCK
    # The core: bytes that every window of the (aligned) block holds.
    core_start = first[owner] + at[owner] + 256 - block * BLOCK
    core = order.hash(core_start, length - BLOCK + 1)
    code = _mixed(core ^ _mixed(group[owner].view(np.uint64) + block.astype(np.uint64)))
    # A block is one entry per context; cores of two contexts or more are alive.
    ends = np.append((owner[1:] != owner[:-1]) | (block[1:] != block[:-1]), True)
    entry = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    _, kind, shared = np.unique(code[entry], return_inverse=True, return_counts=True)
    live = np.flatnonzero(shared[kind] > 1)
    entry, kind, size = entry[live], kind[live], np.diff(np.append(entry, len(owner)))[live]
    # Entries with the same bytes all repeat; one of them stands for the rest.
    extent = size - 1 + length
    bytes_of = order.hash(start[entry], extent) ^ _mixed((kind * 16 + size).astype(np.uint64))
    _, lead, same = np.unique(_mixed(bytes_of), return_index=True, return_inverse=True)
    twin = np.flatnonzero(lead[same] != np.arange(len(entry)))
    if twin.size:
        equal = _equal(text, start[entry[twin]], start[entry[lead[same[twin]]]], extent[twin])
        lone = twin[~equal]  # a collision: sorted for itself
        for i in np.concatenate([twin[equal], lead[same[twin[equal]]]]).tolist():
            at_ = number[entry[i]]
            marks[owner[entry[i]]][at_ : at_ + size[i]] = True
        lead = np.sort(np.concatenate([lead, lone]))
    rivals = np.bincount(kind[lead], minlength=len(shared))[kind[lead]] > 1
    lead = lead[rivals]
    if not lead.size:
        return marks
    suffix = np.repeat(start[entry[lead]], size[lead])
    suffix += np.arange(len(suffix)) - np.repeat(np.cumsum(size[lead]) - size[lead], size[lead])
    # Suffixes of different cores cannot be equal, so every core is sorted for itself.
    for part in _together(np.repeat(kind[lead], size[lead]), BUCKET):
        ranked = order.sort(suffix[part])
        a, b = ranked[:-1], ranked[1:]
        near = np.flatnonzero(order.common(a, b) >= length)
        a, b = a[near], b[near]
        hit = _equal(text, a, b, np.full(len(a), length))  # collision verification
        hit = np.unique(np.concatenate([a[hit], b[hit]]))
        who = np.searchsorted(first, hit, side="right") - 1
        for context, window in zip(who.tolist(), (hit - first[who]).tolist(), strict=True):
            marks[context][window] = True
    return marks


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and b are the same, byte by byte."""
    out = np.ones(len(a), bool)
    span = np.arange(int(size.max()) if len(size) else 0)
    last = len(text) - 1
    for lo in range(0, len(a), 4096):
        part = slice(lo, lo + 4096)
        x = text[np.minimum(a[part][:, None] + span, last)]
        y = text[np.minimum(b[part][:, None] + span, last)]
        out[part] = ((x == y) | (span >= size[part][:, None])).all(axis=1)
    return out


def _together(kind: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Index lists of whole kinds, about ``most`` entries each."""
    order = np.argsort(kind, kind="stable")
    ends = np.flatnonzero(np.append(kind[order][1:] != kind[order][:-1], True)) + 1
    begin = 0
    for end in ends.tolist():
        if end - begin >= most or end == len(order):
            yield order[begin:end]
            begin = end


def _intervals(mark: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_FOUND = "c1 bigint, c2 bigint, begin int, stop int"


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contents that share an anchor, sorted bucket by bucket."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[5] for r in rows]
        first = np.cumsum([0, *map(len, texts)])[:-1]
        place = np.array([r[1] for r in rows], np.int64)
        group = np.array([r[0] for r in rows], np.int64)
        marks = repeated_windows(texts, first, (place >> 8) & 255, place & 255, group, length)
        out = [(r[2], r[3], *i) for r, m in zip(rows, marks, strict=True) for i in _intervals(m)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["c1", "c2", "begin", "stop"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            names = ("anchor", "place", "c1", "c2", "n", "bytes")
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if len(rows) >= 4 * HOT and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "c1", "c2")
    return dealt.mapInArrow(sort, _FOUND)


def _block_entries(contexts: DataFrame, length: int) -> DataFrame:
    """Each content's blocks of windows, with digests of the block's core and of all its bytes."""
    import xxhash

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            columns = (batch[c].to_pylist() for c in ("c1", "c2", "place", "bytes"))
            for c1, c2, place, value in zip(*columns, strict=True):
                at, begin, n = place & 255, 0, (place >> 8) & 255
                while begin < n:
                    block = (at - begin + 256) // BLOCK
                    stop = min(n, at + 256 - block * BLOCK + 1)
                    core = at + 256 - block * BLOCK
                    core_bytes = value[core : core + length - BLOCK + 1]
                    digests.append(xxhash.xxh3_128_digest(core_bytes, block))
                    digests.append(
                        xxhash.xxh3_128_digest(value[begin : stop - 1 + length], at - begin)
                    )
                    rows.append((c1, c2, begin, stop))
                    begin = stop
            codes_ = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
            names = ["c1", "c2", "begin", "stop", "k1", "k2", "u1", "u2"]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            arrays += [pa.array(codes_[:, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return contexts.mapInArrow(
        emit, f"{_FOUND}, k1 bigint, k2 bigint, u1 bigint, u2 bigint"
    )


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contents under a hot anchor, counted by digest.

    Whole blocks first; then, of blocks that share a core but differ, the single windows.
    """
    columns = ("c1", "c2", "begin", "stop")
    entries = stage(_block_entries(contexts, length), "suffix-blocks")
    kinds = entries.groupBy("k1", "k2", "u1", "u2").agg(
        F.count("*").alias("times"), *[F.first(c).alias(c) for c in columns]
    )
    kinds = stage(kinds, "suffix-kinds")
    again = stage(kinds.filter("times > 1").select("u1", "u2"), "suffix-again")
    whole = entries.join(again, ["u1", "u2"]).select(*columns)
    cores = kinds.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    rivals = kinds.join(stage(cores, "suffix-cores"), ["k1", "k2"])
    asked = rivals.groupBy("c1", "c2").agg(
        F.collect_list(F.struct("begin", "stop")).alias("asked")  # at most one per window
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("c1", "c2", "bytes", "asked")
            for c1, c2, value, asked in zip(*(batch[c].to_pylist() for c in names), strict=True):
                at = np.concatenate([np.arange(x["begin"], x["stop"]) for x in asked])
                n = len(at)
                digest = _digests(value, at, np.ones(n, np.int64), length)
                values = (np.full(n, c1), np.full(n, c2), digest[:, 0], digest[:, 1])
                arrays = [pa.array(at, pa.int32()), *(pa.array(x) for x in values)]
                yield pa.RecordBatch.from_arrays(arrays, names=["begin", "c1", "c2", "w1", "w2"])

    windows = contexts.join(asked, ["c1", "c2"]).select("c1", "c2", "bytes", "asked")
    windows = stage(
        windows.mapInArrow(emit, "begin int, c1 bigint, c2 bigint, w1 bigint, w2 bigint"),
        "suffix-windows",
    )
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1")
    found = windows.join(stage(twice.select("w1", "w2"), "suffix-twice"), ["w1", "w2"])
    single = found.select("c1", "c2", "begin", (F.col("begin") + 1).cast("int").alias("stop"))
    return whole.union(single)


# --- whole tables --------------------------------------------------------------------------


def _contexts(rows: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """The bytes of contents, cut from the text of one of their runs.

    Rows that repeat an id and a text are one text here: only the keys are counted to find them,
    and of those few texts each task hands on one.
    """
    wanted = contents.groupBy("id", "code").agg(
        F.collect_list(F.struct("anchor", "place", "c1", "c2", "n")).alias("wanted")
    )
    counts = rows.groupBy("id", "code").agg(F.count("*").alias("rows"))
    repeated = stage(counts.filter("rows > 1").select("id", "code"), "suffix-repeated")
    wanted = stage(wanted, "suffix-wanted")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["id"].eqNullSafe(right["id"]) & (left["code"] == right["code"])

    single = wanted.join(repeated, same(wanted, repeated), "left_anti")
    double = wanted.join(repeated, same(wanted, repeated), "left_semi")
    texts = rows.join(repeated, same(rows, repeated), "left_semi")
    texts = texts.groupBy("id", "code").agg(F.first("text").alias("text"))
    fields = ("anchor", "place", "c1", "c2", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, wanted in zip(batch["text"], batch["wanted"].to_pylist(), strict=True):
                text = value.as_py()
                ends = [
                    (p >> 16, (p >> 16) + ((p >> 8) & 255) - 1 + length)
                    for p in (w["place"] for w in wanted)
                ]
                arrays = [pa.array([w[f] for w in wanted], pa.int64()) for f in fields]
                spans = pa.array([text[a:b] for a, b in ends], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, spans], names=[*fields, "bytes"])

    found = rows.join(single, same(rows, single)).select("text", "wanted")
    found = found.union(texts.join(double, same(texts, double)).select("text", "wanted"))
    return found.mapInArrow(
        cut, "anchor bigint, place bigint, c1 bigint, c2 bigint, n bigint, bytes binary"
    )


def repeated_spans(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
) -> DataFrame:
    """``id, code, spans``: byte spans to remove for each text that has any (they may overlap);
    ``code`` tells apart rows that share a key."""
    if not 0 < length - gram < 255 or gram < BLOCK:
        raise ValueError("a window must be longer than its anchor, by less than 255 bytes")
    rows = _coded(docs, text, key)
    table = stage(_run_table(rows, key, length, gram), "suffix-runs")
    # Counts are staged before a join, so that it reads them apart and its hot keys are split.
    twice = table.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    table = stage(table.join(stage(twice, "suffix-anchors"), "anchor"), "suffix-shared")
    one = [F.first(c).alias(c) for c in ("id", "code", "place", "anchor")]
    contents = table.groupBy("c1", "c2").agg(F.count("*").alias("times"), *one)
    contents = stage(contents, "suffix-contents")
    rivals = contents.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    contested = contents.join(stage(rivals, "suffix-rivals"), "anchor")
    contexts = stage(_contexts(rows, contested, length), "suffix-contexts")
    found = _compare(contexts.filter(F.col("n") <= hot), length).union(
        _count_windows(contexts.filter(F.col("n") > hot), length)
    )
    whole = contents.filter("times > 1").select(
        "c1",
        "c2",
        F.lit(0).alias("begin"),
        F.shiftright("place", 8).bitwiseAND(F.lit(255)).cast("int").alias("stop"),
   
    )
    hits = whole.union(found).groupBy("c1", "c2").agg(
        F.collect_list(F.struct("begin", "stop")).alias("windows")  # at most one per window
    )
    spans = table.join(stage(hits, "suffix-hits"), ["c1", "c2"]).select(
        "id", "code", F.shiftright("place", 16).alias("first"), F.explode("windows").alias("w")
    )
    start, stop = F.col("first") + F.col("w.begin"), F.col("first") + F.col("w.stop") + length - 1
    return spans.groupBy("id", "code").agg(
        F.collect_list(F.struct(start.alias("start"), stop.alias("stop"))).alias("spans")
    )


def _coded(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Key, text and a code that tells apart rows sharing a key."""
    code = F.xxhash64(docs[key], raw(docs[text]))
    return docs.select(docs[key].alias("id"), code.alias("code"), raw(docs[text]).alias("text"))


def remove_repeated(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
) -> DataFrame:
    """``key``, ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and the maximal
    removed ``spans`` of each row."""
    spans = repeated_spans(docs, text, key, length, gram, hot)
    rows = _coded(docs, text, key)
    span = "struct<start:bigint,stop:bigint>"
    kind = f"struct<kept:binary,n_bytes:bigint,n_removed:bigint,spans:array<{span}>>"

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept, sizes, removed, out = [], [], [], []
        for value, found in zip(texts, spans, strict=True):
            data = value.as_py() or b""
            sizes.append(len(data))
            if not found.is_valid:
                kept.append(data)
                removed.append(0)
                out.append([])
                continue
            start = found.values.field("start").to_numpy()
            stop = found.values.field("stop").to_numpy()
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, start, 1)
            np.subtract.at(depth, stop, 1)
            gone = np.cumsum(depth[:-1]) > 0
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            out.append([{"start": a, "stop": b} for a, b in _intervals(gone)])
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return struct(
            {
                "kept": pa.array(kept, pa.binary()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(out, pairs),
            }
        )

    same = rows["id"].eqNullSafe(spans["id"]) & (rows["code"] == spans["code"])
    joined = rows.join(spans, same, "left").select(rows["id"], "text", "spans")
    return joined.select(F.col("id").alias(key), cut("text", "spans").alias("o")).select(key, "o.*")
