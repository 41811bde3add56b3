"""Benchmark decontamination: size-partitioned MinHash containment search.

Texts become lower-case words of letters and digits, and shingles of ``SHINGLE`` words (an item
with fewer words is one shingle of all of them). A text contains an item if it holds at least
``threshold`` of the item's different shingles.

Items are partitioned by size (powers of two of their number of shingles). For each partition
the threshold gives the sketch that cannot miss: whoever holds enough of an item's n shingles
lacks at most n - ceil(threshold * n) of them, so one of any n - ceil(threshold * n) + 1 is
there. The sketch is that many of the item's least hashes (its bottom-k MinHash values), with n
the partition's upper end. Every shingle of every text is looked up among the sketches, which
replaces bands of MinHash values on the text's side: a long text and a short item have a tiny
Jaccard similarity, at which banding loses most of its recall. Candidates are verified by exact
containment on the shingles' words. All of it is DataFrame functions.

Defined results: null and empty texts and items contain nothing and are in nothing; rows sharing
a key count as one text (rows without a key too), items sharing an id as one item each by its
own words, items without an id cannot be named and are left out; a pair is returned once, with
the largest containment. An empty table of texts or items gives no row. Columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.session import stage

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of more rows than this are shuffled, not broadcast (some 50 MB of hashes).
MAX_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: w != "")


def _each(words: Column, width: Column | int, make) -> Column:
    """``make`` of every ``width`` words in a row; an empty array where there are fewer."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(words) - width
    grams = F.transform(F.sequence(F.lit(1), last + 1), lambda i: make(F.slice(words, i, width)))
    return F.when(last >= 0, grams)


def hashes(words: Column, widths: list[int]) -> Column:
    """Hashes of all shingles of the given widths."""
    empty = F.array().cast("array<bigint>")
    found = [F.coalesce(_each(words, w, F.xxhash64), empty) for w in widths]
    return found[0] if len(found) == 1 else F.concat(*found)


def shingles(words: Column, widths: list[int]) -> Column:
    """The different shingles of the given widths, as text."""
    empty = F.array().cast("array<string>")
    found = [
        F.coalesce(_each(words, w, lambda g: F.array_join(g, " ")), empty) for w in widths
    ]
    return F.array_distinct(found[0] if len(found) == 1 else F.concat(*found))


def item_table(benchmark: DataFrame, item: str, text: str, shingle: int) -> DataFrame:
    """``item_id, width, grams`` of every item that has a word, each distinct text once."""
    split = benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("words"))
    width = F.least(F.size("words"), F.lit(shingle))
    rows = split.filter(F.size("words") > 0).select("item_id", "words", width.alias("width"))
    grams = _each(F.col("words"), F.col("width"), lambda g: F.array_join(g, " "))
    return rows.select("item_id", "width", F.array_distinct(grams).alias("grams")).distinct()


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``item_id, hash``: of each item the least hashes that its size's partition asks for."""
    n = F.size("grams")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    needed = F.ceil(F.round(F.lit(threshold) * upper, 6))
    size = F.least(n, (upper - needed + 1).cast("int"))
    coded = F.transform("grams", lambda g: F.xxhash64(F.split(g, " ")))
    least = F.slice(F.array_sort(F.array_distinct(coded)), F.lit(1), size)
    return items.select("item_id", F.explode(least).alias("hash")).distinct()


def contained(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``key, item_id, containment`` of every text and every item in it."""
    items = stage(item_table(benchmark, item, item_text, shingle), "benchmark-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most shingle
    widths = widths or [shingle]
    sketch = sketches(items, threshold)
    small = sketch.count() <= max_broadcast
    sketch = F.broadcast(sketch) if small else sketch
    split = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    coded = split.filter(F.size("words") >= widths[0])
    coded = coded.select("key", F.explode(hashes(F.col("words"), widths)).alias("hash"))
    candidates = coded.join(sketch, "hash").select("key", "item_id").distinct()
    candidates = stage(candidates, "benchmark-candidates")
    # Verification, over the texts that are candidates for something.
    per_text = candidates.groupBy("key").agg(F.collect_set("item_id").alias("found"))
    again = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words")).alias("d")
    suspects = again.join(per_text.alias("c"), F.expr("d.key <=> c.key")).select(
        "d.key", shingles(F.col("d.words"), widths).alias("held"), "c.found"
    )
    pairs = suspects.select("key", "held", F.explode("found").alias("item_id"))
    checked = pairs.join(F.broadcast(items) if small else items, "item_id")
    share = F.size(F.array_intersect("held", "grams")) / F.size("grams")
    checked = checked.select(F.col("key").alias(key), "item_id", share.alias("containment"))
    checked = checked.filter(F.col("containment") >= threshold - 1e-9)
    return checked.groupBy(key, "item_id").agg(F.max("containment").alias("containment"))
