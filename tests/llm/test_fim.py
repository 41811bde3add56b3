"""Fill-in-middle against a plain version of its definition, and in odd cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sharewise.llm import fim

SIGNS = ("<P>", "<S>", "<M>")
CHARS = st.text(st.sampled_from(list("ab\n\n\n\r é語𝄞<PSM>\x8a\x0b")), max_size=60)


def draws(key, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def plainly(key, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, (h1, h2, _, h4) = len(lines), draws(key)
    if not text or any(sign in text for sign in SIGNS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(CHARS, st.integers(0, 99), st.integers(0, 99)), max_size=12), st.integers(1, 80))
def test_cuts_are_those_of_a_list_of_lines(rows, block):
    texts = [text.encode() for text, _, _ in rows]
    array = pa.array([b"before\n", *texts], pa.binary())[1:]
    bounds = np.cumsum([0, *map(len, texts)])
    for a, b in fim.blocks(bounds, block):
        assert bounds[b] - bounds[a] <= block or b == a + 1
    one, two = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    found = np.transpose(fim.cut_batch(array, one, two)).tolist()
    wanted = []
    for text, x, y in rows:
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted((x % (len(lines) + 1), y % (len(lines) + 1)))
        p, m = "".join(lines[:a]), "".join(lines[a:b])
        wanted.append([len(lines), len(p.encode()), len(m.encode()), len(p), len(m)])
    assert found == wanted


@given(st.binary(min_size=8, max_size=64))
def test_marks_and_their_places(data):
    words = np.frombuffer(data[: len(data) // 8 * 8] + bytes(8), "<u8")
    marks = fim.Marks(fim.line_ends(words))
    places = [i for i, byte in enumerate(data[: len(data) // 8 * 8]) if byte == 10]
    assert marks.select(np.arange(1, len(places) + 1)).tolist() == places
    at = np.arange(8 * len(words) - 7)
    assert marks.rank(at).tolist() == [sum(p < i for p in places) for i in at]


ROWS = [
    (1, None), (2, ""), (3, "one line"), (4, "a\nb\nc\n"), (4, "a\nb\nc\n"), (5, "\n\n\n"),
    (6, "x <P> y\nz"), (7, "é語\n𝄞\nlast"), (None, "k\nl\nm"), (8, "ends with <\n<\n<S\n"),
    (9, "line of text\n" * 300_000), (10, "\n"), (11, "no end " * 200_000),
    *[(100 + i, f"first {i}\nsecond <\nthird >\n<M\nfourth") for i in range(40)],
]


def test_table_like_the_definition(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    clash = rows.withColumns({c: F.lit("x") for c in ("n", "form", "output", "cut", "body", "key")})
    made = fim.fill_in_middle(clash)
    found = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(
        repr((key, *plainly(key, text))) for key, text in ROWS
    )
    assert sorted(r.again for r in found) == sorted(text or "" for _, text in ROWS)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(clash.filter("false")).collect() == []


def test_shares_and_other_sentinels(spark):
    rows = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], "doc_id bigint, text string")
    none = fim.fill_in_middle(rows, percent=0).select("form").distinct().collect()
    assert [r.form for r in none] == ["plain"]
    signs = fim.Sentinels("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(rows, percent=50, spm_percent=0, sentinels=signs)
    kinds = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert set(kinds) == {"plain", "psm"} and 140 < kinds["psm"] < 260
    again = made.select(fim.restored(F.col("output"), F.col("form"), signs).alias("t")).distinct()
    assert [r.t for r in again.collect()] == ["a\nb\nc"]


@pytest.mark.parametrize("signs", [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "x", "y")])
def test_sentinels_that_run_into_each_other(signs):
    with pytest.raises(ValueError):
        fim.check(fim.Sentinels(*signs))


def test_bytes_that_are_no_text_stay(spark):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(X'ff0aff0a80' AS STRING) AS text")
    made = fim.fill_in_middle(rows)
    out = made.select(fim.restored(F.col("output"), F.col("form")).cast("binary").alias("t")).first()
    assert bytes(out.t) == b"\xff\x0a\xff\x0a\x80"


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_restores_every_text(spark, sf):
    from sharewise.llm import queries

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    made = queries.fill_in_middle(spark, f"/root/testdata/{sf}")
    own = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own"))
    assert made.count() == docs.count()
    assert made.join(own, "doc_id").filter("own <> restored_sha256").count() == 0
