"""What reaches the libraries: parts of words, and texts in one call."""

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sharewise.llm import packing, tokencount

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
NOTHING = tokencount.LengthTable.build([], [])


def test_plain_words_do_not_go_through_the_whole_library(monkeypatch):
    asked = []
    lengths_of = tokencount.lengths_of
    monkeypatch.setattr(tokencount, "_CACHES", {})
    monkeypatch.setattr(
        tokencount, "lengths_of", lambda words, path: asked.extend(words) or lengths_of(words, path)
    )
    texts = ["Heat, heat. HEAT! it's 3.5 'stuff !!'s Über señor ÀÿZ", "<|endoftext|> x<y 語 é\t"]
    library = tokencount.library(WORDS)
    counts = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokencount.count_texts(texts, NOTHING, WORDS) == counts
    assert sorted(asked) == sorted(["<|endoftext|>", "x<y", "語", "é\t"])


def test_lengths_by_parts_are_the_librarys():
    rng = random.Random(3)
    signs = [*tokencount.PLAIN, *"''''stremvd", "×", "÷", "ª", "語", "\t", "́", "İ"]
    words = ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(20_000)]
    words += [c for c in tokencount.PLAIN] + [a + b for a in "aé9'" for b in tokencount.PLAIN]
    assert tokencount.lengths_by_parts(words, WORDS) == tokencount.lengths_of(words, WORDS)


def test_a_file_that_cuts_otherwise_is_left_to_the_library(tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        known = json.load(file)
    known["normalizer"]["normalizers"].pop()  # keeps capitals
    other = tmp_path / "other.json"
    other.write_text(json.dumps(known), encoding="utf-8")
    assert tokencount.parts_of(WORDS) is not None and tokencount.parts_of(str(other)) is None
    words = ["Heat", "HEAT,"]
    counts = [len(Tokenizer.from_file(str(other)).encode(w, add_special_tokens=False)) for w in words]
    assert tokencount.lengths_by_parts(words, str(other)) == counts


def test_packing_encodes_a_text_in_one_call_and_keeps_no_words():
    words = packing.ByteTokenizer(BYTES)
    library = Tokenizer.from_file(BYTES)
    prose = " ".join(f"word{i}, Über" for i in range(2_000))
    for text in (prose, prose + "\n\n a  b <|endoftext|>\t"):
        found = np.frombuffer(words.ids(text), "<u4").tolist()
        assert found == library.encode(text, add_special_tokens=False).ids
    assert words.ids("") == b""
    assert not any(isinstance(held, dict) and held for held in vars(words).values())
