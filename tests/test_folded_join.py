"""A query joins all pairs with folded case on all columns."""

import __spark_entry__ as entry


def test_folded_join_is_whole(spark, smoke_dir):
    queries = entry.queries()
    whole = queries["pairs_with_metadata_folded_whole"](spark, smoke_dir)
    assert whole.columns == queries["pairs_with_metadata"](spark, smoke_dir).columns
    assert whole.count() == queries["mirror_pairs"](spark, smoke_dir).count()
    early = whole.join(entry.src.test(spark, smoke_dir).select("id"), "id", "left_anti")
    assert not early.filter("lower(project_a) <> project_a AND stars IS NOT NULL").isEmpty()
