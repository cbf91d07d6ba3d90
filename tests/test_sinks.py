"""Sinks that change by whole versions: what a reader sees when a writer stops anywhere."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leafaudit.sources import sinks, versioned

KEYS = ["book", "page"]


def table(spark, *data):
    return spark.createDataFrame([(b, p, e) for b, p, e in data], "book string, page long, entry string")


def keys(spark, *data):
    return spark.createDataFrame(list(data), "book string, page long")


def test_snapshot_is_replaced_kept_and_cleared(spark, tmp_path):
    path = str(tmp_path / "s")
    some = table(spark, ("b", 1, "x"), ("b", 2, "y"))
    assert sinks.read_issue_snapshot(spark, path) is None
    assert sinks.write_issue_snapshot(some.limit(0), path, stage="a", full_run=False) == 0
    assert sinks.read_issue_snapshot(spark, path) is None
    assert sinks.write_issue_snapshot(some, path, stage="a") == 2
    assert sinks.write_issue_snapshot(some.limit(0), path, stage="b", full_run=False) == 0
    assert rows(sinks.read_issue_snapshot(spark, path)) == [("b", 1, "x", "a"), ("b", 2, "y", "a")]
    assert sinks.write_issue_snapshot(some.limit(0), path, stage="b") == 0
    cleared = sinks.read_issue_snapshot(spark, path)
    assert cleared.count() == 0 and cleared.columns == ["book", "page", "entry", "stage"]


def test_snapshot_of_an_epoch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.write_issue_snapshot(table(spark, ("b", 1, "x")), path, stage="a", epoch=5) == 1
    for epoch in (5, 4):
        assert sinks.write_issue_snapshot(table(spark, ("b", 9, "z"), ("b", 8, "z")), path, stage="a", epoch=epoch) == 1
    assert rows(sinks.read_issue_snapshot(spark, path), "page") == [(1,)]
    assert sinks.write_issue_snapshot(table(spark, ("b", 9, "z"), ("b", 8, "z")), path, stage="a", epoch=6) == 2


@pytest.mark.parametrize("step", ["new_folder", "publish"])
def test_a_writer_that_stops_leaves_the_old_snapshot(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "s")
    sinks.write_issue_snapshot(table(spark, ("b", 1, "old")), path, stage="a")
    with monkeypatch.context() as m:
        m.setattr(versioned, step, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            sinks.write_issue_snapshot(table(spark, ("b", 2, "new")), path, stage="a")
    assert rows(sinks.read_issue_snapshot(spark, path), "entry") == [("old",)]
    sinks.write_issue_snapshot(table(spark, ("b", 2, "new")), path, stage="a")
    assert rows(sinks.read_issue_snapshot(spark, path), "entry") == [("new",)]


def test_index_replaces_removes_and_keeps(spark, tmp_path):
    path = str(tmp_path / "i")
    base = [(f"b{i % 5}", i, "old") for i in range(40)]
    assert sinks.upsert_index(table(spark, *base), keys(spark), path, KEYS, buckets=8) == 0
    updates, gone = table(spark, ("b1", 1, "new"), ("z", 99, "new")), keys(spark, ("b2", 2), ("q", 7))
    before = versioned.current(spark, path).parts
    for _ in range(2):  # a repeated batch changes nothing
        sinks.upsert_index(updates, gone, path, KEYS)
        want = sorted([r for r in base if r[1] not in (1, 2)] + [("b1", 1, "new"), ("z", 99, "new")])
        assert rows(sinks.read_index(spark, path)) == want
    after = versioned.current(spark, path)
    assert after.buckets == 8 and sum(before[k] == after.parts.get(k) for k in before) >= 4
    assert versioned.drop_old(spark, path, keep=1) >= 1
    assert rows(sinks.read_index(spark, path)) == want
    sinks.upsert_index(table(spark), sinks.read_index(spark, path).select(*KEYS), path, KEYS)
    assert sinks.read_index(spark, path).count() == 0


def test_index_survives_a_crash_between_write_and_flip(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    sinks.upsert_index(table(spark, ("b", 1, "old"), ("b", 2, "old")), keys(spark), path, KEYS, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(versioned, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            sinks.upsert_index(table(spark, ("b", 1, "new")), keys(spark), path, KEYS)
    assert rows(sinks.read_index(spark, path), "entry") == [("old",), ("old",)]
    sinks.upsert_index(table(spark, ("b", 1, "new")), keys(spark), path, KEYS)
    assert rows(sinks.read_index(spark, path), "page", "entry") == [(1, "new"), (2, "old")]


def test_of_two_writers_from_one_version_one_starts_over(spark, tmp_path):
    path = str(tmp_path / "i")
    sinks.upsert_index(table(spark, ("b", 1, "x")), keys(spark), path, KEYS)
    last = versioned.current(spark, path)
    sinks.upsert_index(table(spark, ("b", 2, "y")), keys(spark), path, KEYS)
    with pytest.raises(versioned.Conflict):
        versioned.publish(spark, path, versioned.Version(last.number + 1, last.schema))
    assert sinks.read_index(spark, path).agg(F.count("*")).first()[0] == 2
