"""Published versions: crashed writers, races and late records; malformed records."""

import json

import pytest
from pyspark.sql import functions as F

from sharewise import schemas
from sharewise.sources import snapshots, tables

def records(spark, *rows):
    """``(name, stars, day)``; a null day is a record without a date."""
    made = [
        {"full_name": n, "stargazers_count": s, "updated_at": d and f"2024-01-{d:02d}T00:00:00Z"}
        for n, s, d in rows
    ]
    shape = "full_name string, stargazers_count bigint, updated_at string"
    df = spark.createDataFrame(made, shape)
    missing = [f for f in schemas.REPO_METADATA if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})

def held(spark, path):
    got = snapshots.read_versioned(
        spark, path, schemas.REPO_METADATA, F.lower("full_name"), "updated_at"
    )
    return {} if got is None else {r.full_name.lower(): r.stargazers_count for r in got.collect()}

def test_newest_record_counts_whenever_it_comes(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert held(spark, path) == {}
    tables.merge_metadata(spark, path, records(spark, ("a/b", 1, 5), ("A/B", 2, 6), ("c/d", 3, 1)))
    assert held(spark, path) == {"a/b": 2, "c/d": 3}
    got = tables.merge_metadata(spark, path, records(spark, ("a/b", 9, 4), ("c/d", 4, 2), ("e/f", 5, None)))
    assert held(spark, path) == {"a/b": 2, "c/d": 4, "e/f": 5}  # the record of day 4 came late
    assert got.schema == schemas.REPO_METADATA and got.count() == 3
    tables.merge_metadata(spark, path, records(spark, ("e/f", 6, 1), (None, 7, 9)))
    assert held(spark, path) == {"a/b": 2, "c/d": 4, "e/f": 6}

def test_what_a_crashed_writer_left_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "meta")
    tables.merge_metadata(spark, path, records(spark, ("a/b", 1, 1)))
    with monkeypatch.context() as crash:
        crash.setattr(snapshots, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            tables.merge_metadata(spark, path, records(spark, ("a/b", 2, 2)))
    (tmp_path / "meta" / "_versions" / ".half").write_text('{"vers')
    assert held(spark, path) == {"a/b": 1}
    tables.merge_metadata(spark, path, records(spark, ("c/d", 3, 1)))
    assert held(spark, path) == {"a/b": 1, "c/d": 3}
    whole = str(tmp_path / "whole")
    with pytest.raises(ZeroDivisionError):
        snapshots.materialize_once(spark, whole, lambda: 1 / 0)
    with monkeypatch.context() as crash:
        crash.setattr(snapshots, "rename_new", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            snapshots.materialize_once(spark, whole, lambda: spark.range(5))
    assert snapshots.materialize_once(spark, whole, lambda: spark.range(3)).count() == 3

def test_two_writers_lose_nothing(spark, tmp_path):
    path, seen = str(tmp_path / "meta"), []

    def fetch(wanted):
        names = sorted(r.project for r in wanted.collect())
        seen.append(names)
        if len(seen) == 1:  # another writer publishes while this one is fetching
            tables.merge_metadata(spark, path, records(spark, ("a/b", 5, 9), ("x/y", 6, 1)))
        return records(spark, *[(n, 1, 1) for n in names])

    wanted = spark.createDataFrame([("a/b",), ("c/d",)], "project string")
    got = tables.refresh_metadata(spark, path, wanted, fetch)
    assert seen == [["a/b", "c/d"], ["c/d"]]  # asked again, for what the other has not brought
    assert {r.full_name: r.stargazers_count for r in got.collect()} == {"a/b": 5, "x/y": 6, "c/d": 1}
    assert held(spark, path) == {"a/b": 5, "x/y": 6, "c/d": 1}

def test_two_builders_of_a_snapshot_agree(spark, tmp_path):
    path = str(tmp_path / "whole")

    def slow():
        snapshots.materialize_once(spark, path, lambda: spark.range(4))
        return spark.range(9)

    assert snapshots.materialize_once(spark, path, slow).count() == 4
    (tmp_path / "mine").mkdir()
    with pytest.raises(FileExistsError):
        snapshots.materialize_once(spark, str(tmp_path / "mine"), lambda: spark.range(2))

def test_parts_are_put_together_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_PARTS", 3)
    path = str(tmp_path / "meta")
    for i in range(6):
        tables.merge_metadata(spark, path, records(spark, ("a/b", i, i + 1), (f"p/{i}", i, 1)))
    version, parts = snapshots.current_version(spark, path)
    assert version == 6 and len(parts) <= 3
    assert held(spark, path) == {"a/b": 5, **{f"p/{i}": i for i in range(6)}}

# --- malformed records ---------------------------------------------------------------------

LINES = [
    "id,project_a,project_b,weight_a,weight_b", "1,a/b,c/d,0.5,0.5", '2,"a,b",c/d,0.25,0.75',
    "x,a/b,c/d,0.5,0.5", "4,a/b,c/d,half,0.5", "5,a/b,c/d,0.5", "6,a/b,c/d,0.5,0.5,1", ",a/b,c/d,1,0",
    "8,,c/d,,",
]

def test_malformed_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("\n".join(LINES))
    path, aside = str(tmp_path / "pairs.csv"), str(tmp_path / "bad")
    good, bad = tables.read_pairs_checked(spark, path, quarantine=aside)
    assert good.schema == schemas.TRAIN_PAIRS
    assert sorted(r.id for r in good.collect()) == [1, 2, 8]
    reasons = sorted((r.reason, r.record) for r in bad.collect())
    assert [r for r, _ in reasons] == ["fields", "fields", "id", "value", "value"]
    assert ("fields", LINES[5]) in reasons and ("value", LINES[3]) in reasons
    assert spark.read.parquet(aside).count() == 5
    with pytest.raises(tables.MalformedRecords, match="fields"):
        tables.read_pairs_checked(spark, path, strict=True)
    (tmp_path / "fine.csv").write_text("\n".join(LINES[:3]))
    fine, none = tables.read_pairs_checked(spark, str(tmp_path / "fine.csv"), strict=True)
    assert fine.count() == 2 and none.count() == 0

def test_malformed_metadata_is_set_apart(spark, tmp_path):
    good = {"full_name": "a/b", "created_at": "2024-02-29T01:02:03Z", "updated_at": None}
    wrong = {"full_name": "c/d", "created_at": "2023-02-29T01:02:03Z"}
    typed = {"full_name": "e/f", "stargazers_count": "many"}
    lines = [json.dumps(x) for x in (good, wrong, typed, {})] + ['{"full_name": "g/h", ', "[]"]
    (tmp_path / "meta.json").write_text("\n".join(lines))
    path = str(tmp_path / "meta.json")
    rows, bad = tables.read_metadata_checked(spark, path)
    assert [r.full_name for r in rows.collect()] == ["a/b"]
    assert rows.schema == schemas.REPO_METADATA
    found = {r.reason: 0 for r in bad.collect()}
    for r in bad.collect():
        found[r.reason] += 1
    assert found["date"] == 1 and found["json"] >= 2
    with pytest.raises(tables.MalformedRecords):
        tables.read_metadata_checked(spark, path, strict=True)
