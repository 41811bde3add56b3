"""Benchmark items without an id are kept out of the training data too."""

import corpus_pipeline
from sharewise.llm import queries


def test_item_without_an_id_is_a_leak(spark, monkeypatch):
    item = "which river runs through the old town and under the seven stone bridges"
    items = spark.createDataFrame([(None, item), (1, "of another kind")], "item_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *_: items)
    rows = [(1, f"so {item} so"), (None, item), (2, "a clean text of its own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = corpus_pipeline.remove_benchmark(spark, docs, "")
    assert [r.doc_id for r in left.collect()] == [2]
