"""Token counts against the library on whole texts, and in odd cases."""

import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sharewise.llm import queries, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
NOTHING = tokencount.LengthTable.build([], [])
PIECES = [
    " ", "\n", "  ", "\t", "\r\n", "\xa0", " ", "\x85", "\x1c", "\x1f", "​", "　",
    "a", "The", "word", "WORD,", "it's", "'S", "don't", "12", "3.5", "é", "é", "́",
    "İ", "ΣΑΣ", "ß", "語", "𝄞", "👩‍👩", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
    "<|endoftext", "|>", "</w>", "!!!", "-", "_", "�", "\x00", "ﬁ", "Å", "하",
]


def whole(text):
    return len(tokencount.library(PATH).encode(text, add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_counts_are_the_librarys(text):
    assert tokencount.count_texts([text], NOTHING, PATH) == [whole(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert tokencount.count_texts([text], NOTHING, PATH) == [whole(text)]


def test_long_texts_are_cut_between_pretokens(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(400)) for _ in range(20)]
    texts += ["", "x" * 300_000, "ab " * 200_000, "\n" * 1000]
    monkeypatch.setattr(tokencount, "PIECE", 50)
    monkeypatch.setattr(tokencount, "TOGETHER", 30)
    monkeypatch.setattr(tokencount, "CACHED", 5)
    assert tokencount.count_texts(texts, NOTHING, PATH) == [whole(t) for t in texts]


def test_table_holds_what_it_was_given():
    words = [f"w{i}" for i in range(5000)]
    table = tokencount.LengthTable.build(words, [i % 7 + 1 for i in range(5000)])
    assert table.find(words).tolist() == [i % 7 + 1 for i in range(5000)]
    assert not table.find([f"v{i}" for i in range(5000)]).any()
    assert table.find([]).tolist() == [] and NOTHING.find(["a"]).tolist() == [0]
    assert len(table.tokens) <= 4 * len(words)


def test_summary_keeps_frequent_words_and_stays_small():
    rng = random.Random(2)
    words = ["often"] * 3000 + ["too"] * 2000 + [f"w{rng.random()}" for _ in range(20_000)]
    rng.shuffle(words)
    found: Counter = Counter()
    for start in range(0, len(words), 100):
        tokencount.add(found, words[start : start + 100], 50)
        assert len(found) <= 200
    assert [w for w, _ in found.most_common(2)] == ["often", "too"]


def test_vocabulary_that_needs_the_space_is_refused():
    tokencount.check(PATH)
    with pytest.raises(ValueError):
        tokencount.check(public_tokenizers.path("byte_bpe_50k.json"))


def test_rows_of_a_table(spark):
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "the the <|endoftext|> the"), (4, "the the x"),
        (None, "a word"), (5, "word " * 60_000), (6, "z" * 200_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.withColumns({"n": F.lit("x"), "word": F.lit("x"), "n_tokens": F.lit("x")})
    table = tokencount.frequent(docs, PATH, size=2)
    assert table.find(["the", "word", "a"]).tolist() == [1, 1, 0]  # the two most frequent
    found = docs.select("doc_id", tokencount.token_counts(docs, table, PATH).alias("c")).collect()
    assert Counter(map(tuple, found)) == Counter((k, whole(t or "")) for k, t in rows)
    none = docs.filter("false")
    empty = tokencount.frequent(none, PATH)
    assert not empty.tokens.any()
    assert none.select(tokencount.token_counts(none, empty, PATH)).collect() == []


def test_query_counts_every_text(spark):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in queries.token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for row in docs:
        n, text = whole(row.text or ""), row.text or ""
        answer = found[row.doc_id]
        assert (answer.n_tokens, answer.n_bytes, answer.over_limit) == (
            n, len(text.encode()), n > 2048,
        )
