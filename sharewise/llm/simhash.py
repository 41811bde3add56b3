"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. Two
fingerprints are linked if they differ in at most ``max_bits`` bits.

Candidates. The 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in at
most t bits, then from some segment on, the differences summed over the next l segments are at
most ``t * l / SEGMENTS`` for every l. So over a chain of ``chain`` segments few of them can
differ at all, and where they may is known: each way leaves exact segments, which are joined
on. For three bits, eight segments and chains of five that is a join on 32 exact bits, 24 ways.
Before the full Hamming check the rest of the chain's budgets prunes what only shares a key.

Skew. Equal fingerprints are one node. Keys that many different fingerprints share (families of
near copies) are not joined: their fingerprints are dealt by every choice of 16 - ``max_bits``
exact nibbles instead, which any linked pair shares, and of which a group holds at most
``16 ** max_bits`` fingerprints whatever the data (4,096 for three bits). A group yields the
links of a spanning forest, not all pairs, so links grow with the rows and none is lost. A key,
fingerprint or component that holds more than a task's load is split where it is looked up.

Driver. Every table here grows with the rows, and Catalyst takes keys for as few as the fingerprints
they were exploded from and staged files for what they weigh compressed. So joins shuffle: none is
broadcast for its estimate.

Defined results: a null text is an empty one; a text without a word has fingerprint zero,
linked like any other; with fewer words than a shingle all words are one shingle. Repeated rows
share their component. An empty table gives no row. A null key gets the component of its text and names no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.components import connected
from sharewise.llm.text import raw
from sharewise.operators.joins import salted_join
from sharewise.session import stage

SEED = 42
SEGMENTS = 8
CHAIN = 5
#: Keys shared by more fingerprints than this are dealt by nibbles.
HOT = 48
BLOCK = 50_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The fingerprint of a whole text, unsigned."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    width = min(shingle, len(words))
    n = len(words) - width + 1
    set_in = np.zeros((8, 8), np.int64)
    for start in range(0, n, BLOCK):
        part = words[start : min(start + BLOCK, n) + width - 1]
        grams = zip(*(part[k:] for k in range(width)), strict=False)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64
        )
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            set_in[k] += np.bincount(octets[:, k], minlength=256) @ _BITS
    bits = (2 * set_in > n).ravel()
    return sum(1 << k for k in np.flatnonzero(bits).tolist())


def fingerprints(text: Column | str, shingle: int = 3) -> Column:
    """The fingerprint as a bigint with the same 64 bits."""

    @F.arrow_udf("bigint")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return answer(raw(text))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def chain_masks(max_bits: int, segments: int = SEGMENTS, chain: int = CHAIN) -> list[tuple]:
    """``(bits to join on, [(bits, budget) of the rest of the chain])`` for every way in which
    a chain can keep within its budgets."""
    if max_bits >= segments or 64 % segments:
        raise ValueError("segments must divide 64 and outnumber the bits that may differ")
    width = 64 // segments
    budget = [max_bits * length // segments for length in range(segments + 1)]

    def ring(start: int, places) -> int:
        spots = ((start + p) % segments * width for p in places)
        return sum(((1 << width) - 1) << s for s in spots)

    ways = [
        set(way)
        for way in combinations(range(chain), budget[chain])
        if all(sum(p < length for p in way) <= budget[length] for length in range(1, chain + 1))
    ]
    out = []
    for start in range(segments):
        rest = [
            (_signed(ring(start, range(length))), budget[length])
            for length in range(chain, segments)
        ]
        for way in ways:
            out.append((_signed(ring(start, set(range(chain)) - way)), rest))
    return out


def _long(mask: int) -> Column:
    return F.lit(mask).cast("bigint")


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among different fingerprints, a spanning forest."""
    rest, links = values, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = []
            for node in front:
                # Unsigned: of a signed number the bits of its absolute value are counted.
                near = np.bitwise_count((rest ^ node).view(np.uint64)) <= max_bits
                if near.any():
                    found.append(rest[near])
                    links.extend((int(node), int(x)) for x in rest[near])
                    rest = rest[~near]
            front = np.concatenate(found) if found else rest[:0]
    return links


def _family_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of hot keys, by exact nibbles."""
    masks = [
        _signed(sum(15 << 4 * k for k in range(16) if k not in way))
        for way in combinations(range(16), max_bits)
    ]
    dealt = hot.select("fp", F.explode(F.array(*map(_long, masks))).alias("mask"))
    groups = (
        dealt.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        .agg(F.collect_list("fp").alias("fps"))
        .filter("size(fps) > 1")
        .select(F.array_sort("fps").alias("fps"))
    )

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def forest(lists: pa.Array) -> pa.Array:
        out = [
            [{"a": a, "b": b} for a, b in _forest(x.values.to_numpy(), max_bits)] for x in lists
        ]
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return groups.select(F.explode(forest("fps")).alias("link")).select("link.*").distinct()


def links(
    nodes: DataFrame, max_bits: int, segments: int = SEGMENTS, chain: int = CHAIN, hot: int = HOT
) -> DataFrame:
    """``a, b`` that connect all fingerprints (column ``fp``, each once) at most ``max_bits``
    apart; every returned pair is that near."""
    ways = chain_masks(max_bits, segments, chain)
    steps = F.array(
        *[F.struct(F.lit(k).alias("way"), _long(m).alias("mask")) for k, (m, _) in enumerate(ways)]
    )
    keys = nodes.select("fp", F.explode(steps).alias("step"))
    masked = F.col("fp").bitwiseAND(F.col("step.mask"))
    keys = keys.select("fp", F.struct("step.way", masked.alias("key")).alias("spot"))
    shared = keys.groupBy("spot").agg(F.count("*").alias("n")).filter("n > 1")
    counts = shared.withColumnRenamed("n", "__n")
    members = salted_join(
        keys, shared, "spot", ["fp"], how="inner", counts=counts, shuffled=True
    )
    members = stage(members.select("fp", "spot.way", "spot.key", "n"), "simhash-keys")
    cold = members.filter(F.col("n") <= hot)
    pairs = cold.select("way", "key", F.col("fp").alias("a")).join(
        cold.select("way", "key", F.col("fp").alias("b")).hint("merge"), ["way", "key"]
    )
    pairs = pairs.filter("a < b")
    # The way's chain goes on to the whole ring; its later budgets, then the full check.
    per_start = len(ways) // segments
    for k in range(len(ways[0][1])):
        budget = ways[0][1][k][1]
        marks = F.array(*[_long(ways[s * per_start][1][k][0]) for s in range(segments)])
        start = F.floor(F.col("way") / per_start).cast("int")
        both = F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.get(marks, start))
        pairs = pairs.filter(F.bit_count(both) <= budget)
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()
    family = members.filter(F.col("n") > hot).select("fp").distinct()
    return pairs.union(_family_links(family, max_bits))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the smallest key reachable) for each row."""
    prints = docs.select(F.col(key).alias("key"), fingerprints(docs[text], shingle).alias("fp"))
    prints = stage(prints, "simhash-prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("key").alias("least")), "simhash-nodes")
    roots = connected(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(
        F.min("least").alias("component_id"), F.count("*").alias("__n")
    )
    placed = salted_join(
        placed.select("fp", "root"), named.drop("__n"), "root", ["fp"], how="inner", counts=named,
        shuffled=True,
    ).select("fp", "component_id")
    found = salted_join(prints, placed, "fp", ["key"], how="inner", shuffled=True)
    return found.select(F.col("key").alias(key), "fp", "component_id")


def as_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
