from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallygrid.sources import keyed
from tallygrid.sources.keyed import Conflict, KeyedTable


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, v int, note string")


def content(table, version=None):
    return {r["id"]: r["v"] for r in table.read(version).collect()}


def test_writes_over_by_key_and_keeps_versions(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.upsert(frame(spark, [(f"k{i}", i, "a") for i in range(50)])) == 1
    assert table.upsert(frame(spark, [("k3", -3, "b"), ("new", 7, "b")])) == 2
    want = {f"k{i}": i for i in range(50)}
    assert content(table, 1) == want
    assert content(table) == want | {"k3": -3, "new": 7}
    assert table.versions() == [1, 2]
    touched = {b.folder for b in table.manifest(2).buckets} - {
        b.folder for b in table.manifest(1).buckets}
    assert 1 <= len(touched) <= 2  # the other buckets were not rewritten
    assert table.upsert(frame(spark, [])) == 3 and content(table) == content(table, 2)


def test_another_number_of_buckets_cannot_double_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    KeyedTable(spark, path, buckets=4).upsert(frame(spark, [(f"k{i}", i, "a") for i in range(40)]))
    KeyedTable(spark, path, key="note", buckets=7).upsert(
        frame(spark, [(f"k{i}", -i, "b") for i in range(40)]))
    table = KeyedTable(spark, path)
    assert content(table) == {f"k{i}": -i for i in range(40)} and table.read().count() == 40
    assert {b.size for b in table.manifest().buckets} == {4}


def test_repeated_new_keys_are_written_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    rows = [("a", 1, "x"), ("a", 3, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 1, "x")]
    table.upsert(frame(spark, rows), version="v")
    assert table.read().count() == 2 and content(table) == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        table.upsert(frame(spark, [(None, 1, "x")]))
    assert table.versions() == [1]


def test_buckets_split_when_they_grow(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=2, bucket_rows=20)
    want = {}
    for step in range(4):
        rows = {f"k{i}": step for i in range(step * 50, step * 50 + 60)}
        want |= rows
        table.upsert(frame(spark, [(k, v, "") for k, v in rows.items()]))
        buckets = table.manifest().buckets
        assert sum(b.rows for b in buckets) == len(want) and content(table) == want
        assert sum(1 / b.size for b in buckets) == 1.0  # every hash has one bucket
    assert max(b.size for b in buckets) > 2


def test_killed_between_write_and_switch(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"))
    table.upsert(frame(spark, [("a", 1, "x")]))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(keyed.KeyedTable, "_switch", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(frame(spark, [("a", 2, "x"), ("b", 2, "x")]))
    monkeypatch.undo()
    assert content(table) == {"a": 1} and table.versions() == [1]
    assert table.vacuum() > 0 and content(table) == {"a": 1}
    table.upsert(frame(spark, [("b", 3, "x")]))
    assert content(table) == {"a": 1, "b": 3}


def test_one_of_two_writers_wins(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    table.upsert(frame(spark, [("a", 1, "x")]))
    with pytest.raises(Conflict):
        table._switch(table.manifest())
    assert content(table) == {"a": 1}


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=3)
    for v in range(4):
        table.upsert(frame(spark, [(f"k{i}", v, "") for i in range(v * 5, 20)]))
    before = content(table)
    assert table.vacuum(keep=2) > 0
    assert table.versions() == [3, 4] and content(table) == before and content(table, 3)


def test_columns_may_be_added(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    table.upsert(frame(spark, [("a", 1, "x"), ("b", 1, "x")]))
    table.upsert(frame(spark, [("a", 2, "y")]).withColumn("more", F.lit(1.5)))
    rows = {r["id"]: r["more"] for r in table.read().collect()}
    assert rows == {"a": 1.5, "b": None}


def test_whole_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    """A write moves a row once, and a first one writes it once; large buckets are dealt to parts."""
    moved, written = [], []
    one_per_key = keyed.KeyedTable._one_per_key

    def seen(self, *args):
        merged = one_per_key(self, *args)
        moved.append(merged._jdf.queryExecution().executedPlan().toString().count("Exchange hash"))
        written.append([p.name for p in (tmp_path / "t").rglob("*-incoming")])
        return merged

    monkeypatch.setattr(keyed.KeyedTable, "_one_per_key", seen)
    monkeypatch.setattr(keyed, "PART_ROWS", 1)
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=1)
    table.upsert(frame(spark, [(f"k{i % 60}", i, "a") for i in range(80)]), version="v")
    table.upsert(frame(spark, [(f"k{i}", -i, "b") for i in range(20, 25)]))
    assert moved == [1, 1] and written[0] == [] and len(written[1]) == 1
    want = {f"k{i % 60}": i for i in range(80)} | {f"k{i}": -i for i in range(20, 25)}
    assert content(table) == want and table.read().count() == 60
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u")).upsert(frame(spark, [(None, 1, "x")]))
    assert KeyedTable(spark, str(tmp_path / "u")).versions() == []
