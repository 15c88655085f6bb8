"""Keyed upserts of a stored table: rows, versions, what is written again, and crashes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citetrace.plans.keyed_table import KeyedTable

SCHEMA = "k string, n long, a string, day date"


def table(spark, tmp_path, **more):
    return KeyedTable(spark, f"file://{tmp_path}/works", SCHEMA, ["k", "n"], **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_batches_equal_a_dictionary(spark, tmp_path):
    rnd, want = random.Random(2), {}
    t = table(spark, tmp_path, file_rows=40)
    for n in range(4):
        batch = {(f"k{rnd.randrange(60)}", rnd.randrange(3)): rnd.choice(("x", "y", None)) for _ in range(50)}
        t.upsert(frame(spark, [(*k, v, None) for k, v in batch.items()]), number=n)
        want |= batch
        if n == 2:
            gone = list(want)[::5]
            t.delete(spark.createDataFrame(gone, "k string, n long"))
            for k in gone:
                del want[k]
        assert rows(t.read()) == Counter((*k, v, None) for k, v in want.items())
    t.upsert(frame(spark, [("k0", 0, "late", None)]), number=2)  # a batch that was taken
    assert rows(t.read()) == Counter((*k, v, None) for k, v in want.items())


def test_only_files_that_hold_a_key_are_written_again(spark, tmp_path):
    t = table(spark, tmp_path, file_rows=1000)
    t.upsert(spark.range(10_000).selectExpr("concat('k', lpad(id * 2, 8, '0')) k", "1L n", "'old' a", "date'2020-01-01' day"))
    files = {f["path"] for f in t.said()["files"]}
    assert len(files) >= 8
    one = t.upsert(frame(spark, [("k00000010", 1, None, None)]))  # a key that is there
    assert (one["rewritten"], one["left_alone"]) == (1, len(files) - 1) and one["written_rows"] < 2_500
    new = t.upsert(frame(spark, [("k00000011", 1, "new", None), ("k00012001", 1, "new", None)]))  # within the ranges, but in no file
    assert (new["rewritten"], new["left_alone"], new["written_rows"]) == (0, len(files), 2)
    both = t.upsert(frame(spark, [("k00000011", 1, "newer", None), ("k00019998", 1, "end", None), ("zzz", 1, "new", None)]))
    assert both["rewritten"] == 2
    assert t.read().count() == 10_003
    assert rows(t.read().where("a is null or a <> 'old'").select("k", "a")) == Counter([("k00000010", None), ("k00000011", "newer"), ("k00012001", "new"), ("k00019998", "end"), ("zzz", "new")])
    gone = t.delete(spark.createDataFrame([("none", 1)], "k string, n long"))
    assert (gone["rewritten"], gone["written_rows"]) == (0, 0)


def test_versions_stay_until_they_are_dropped(spark, tmp_path):
    t = table(spark, tmp_path)
    for v in "abc":
        t.upsert(frame(spark, [("k", 1, v, None)]))
    assert [t.read(n).first().a for n in t.versions()] == ["a", "b", "c"]
    t.drop_versions(2)
    assert [t.read(n).first().a for n in t.versions()] == ["b", "c"]
    assert len(list((tmp_path / "works/files").glob("*/*.parquet"))) == 2


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(frame(spark, [("k", 1, "a", None), ("l", 1, "b", None)]), number=0)
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, said: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.upsert(frame(spark, [("k", 1, "c", None)]), number=1)
    monkeypatch.undo()
    assert rows(t.read()) == Counter([("k", 1, "a", None), ("l", 1, "b", None)])
    t.upsert(frame(spark, [("k", 1, "c", None)]), number=1)
    assert rows(t.read().select("k", "a")) == Counter([("k", "c"), ("l", "b")])


def test_equal_keys_and_null_keys(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.upsert(frame(spark, []))["written_rows"] == 0
    seq = spark.createDataFrame([("k", 1, "first", None, 1), ("k", 1, None, None, 3), ("k", 1, "second", None, 2), ("l", 1, "x", None, None)], SCHEMA + ", seq long")
    t.upsert(seq.withColumn("extra", F.lit(1)), order=["seq"])
    assert rows(t.read()) == Counter([("k", 1, None, None), ("l", 1, "x", None)])
    with pytest.raises(ValueError):
        t.upsert(frame(spark, [(None, 1, "x", None)]))


def test_many_files_are_found_without_comparing_each_key_with_each(spark, tmp_path, monkeypatch):
    from citetrace.plans import keyed_table

    monkeypatch.setattr(keyed_table, "FEW_FILES", 3)
    t = table(spark, tmp_path, file_rows=100)
    even = spark.range(1_000).selectExpr("concat('k', lpad(id * 2, 8, '0')) k", "1L n", "'old' a", "date'2020-01-01' day")
    t.upsert(even)
    t.upsert(spark.range(300).selectExpr("concat('k', lpad(id * 2 + 1, 8, '0')) k", "1L n", "'new' a", "date'2020-01-01' day"))
    asked = spark.range(-5, 2_500, 3).selectExpr("struct(concat('k', lpad(id, 8, '0')) k, 1L n) _key")
    ranges = spark.read.parquet(*{f"{t.folder}/index/{f['index']}/ranges" for f in t.said()["files"]}).withColumn("_index", F.split_part("_file", F.lit("/"), F.lit(2)))
    live = [f["path"] for f in t.said()["files"]]
    ranges, indexes = ranges.where(F.col("_file").isin(live)), sorted({f["index"] for f in t.said()["files"]})
    near = t._near(ranges, indexes, asked, len(live))
    assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()
    plain = asked.join(ranges, F.col("_key").between(F.col("_low"), F.col("_high"))).select("_file", "_key", "_size")
    assert rows(near) == rows(plain) and len(live) > 3
    t.upsert(frame(spark, [("k00000010", 1, "newer", None), ("k00000011", 1, "newer", None), ("k99999999", 1, "newer", None)]))
    assert t.read().count() == 1_301 and t.read().where("a = 'newer'").count() == 3
