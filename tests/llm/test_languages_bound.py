"""A dirty language column does not make a huge model."""

from pyspark.sql import functions as F

from sharewise.llm import langid, quality

WORDS = {"en": "the cat and the dog went on", "de": "der hund und die katze gingen weiter"}


def docs_of(spark):
    rows = [(i, f"{WORDS[lang]} " * 12, lang) for lang in WORDS for i in range(30)]
    rows += [(100 + i, f"noise{i} words{i} here{i}", f"x{i:05d}") for i in range(10_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_ten_thousand_languages(spark):
    docs = docs_of(spark)
    model = langid.fit(docs)
    assert len(model.languages) == langid.MOST_LANGUAGES == model.log_prob.shape[1]
    assert {"en", "de"} < set(model.languages)
    assert langid.classify("the cat went on and on", model)[0] == "en"
    reference = quality.references(docs)
    assert len(reference.languages) == quality.MOST_LANGUAGES
    assert {"en", "de"} < set(reference.languages)


def test_text_without_a_letter_is_undetermined(spark):
    model = langid.fit(docs_of(spark).filter("length(lang) = 2"))
    assert langid.classify(" 12 ,. ", model) == ("und", 0.0)
    assert langid.classify("", model) == ("und", 0.0)
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert quality.references(empty).languages == []
    assert empty.select(F.struct(langid.predict(empty, model))).collect() == []
