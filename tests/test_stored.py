"""Tables on disk that changes are merged into: only changed buckets are written, retries change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources.stored import StoredTable


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def content(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", k % 3) for k in range(200)], "uri long, label string, v int")
    return StoredTable.create(rows, str(tmp_path / "t"), ["uri"], 8)


def test_untouched_buckets_keep_their_files(spark, table):
    before = files(table.path)
    assert len(before) == 8 and all(len(f) == 1 for f in before.values())
    new = spark.createDataFrame([(5, "five", None), (1000, "more", 7)], "uri long, label string, v int")
    changed = table.merge(new)
    after = files(table.path)
    assert 1 <= len(changed) <= 2
    assert {d for d in after if after[d] != before[d]} == {f"bucket={b}" for b in changed}
    assert content(table) == sorted([(k, "five" if k == 5 else f"n{k}", k % 3) for k in range(200)] + [(1000, "more", 7)], key=repr)
    assert table.merge(new) == [] and files(table.path) == after  # a second run changes nothing
    assert table.merge(new, clear=["v"]) != [] and (5, "five", None) in content(table)
    assert table.update(spark.createDataFrame([(5, 9), (77777, 9)], "uri long, v int")) != [] and (5, "five", 9) in content(table)
    assert table.merge(new.limit(0)) == []


def test_a_change_that_was_broken_off(spark, table, monkeypatch):
    want = content(table)
    new = spark.createDataFrame([(k, "x", 1) for k in range(0, 200, 2)], "uri long, label string, v int")
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "finish", lambda self: None)  # written beside the table, then lost
        table.merge(new)
        assert content(table) == want
    done = content(StoredTable(spark, table.path))
    assert done == sorted([(k, "x" if k % 2 == 0 else f"n{k}", 1 if k % 2 == 0 else k % 3) for k in range(200)], key=repr)
    assert not os.path.exists(f"{table.path}/_pending")
    os.makedirs(f"{table.path}/_pending")  # not wholly written: as if it had not been tried
    assert content(StoredTable(spark, table.path)) == done and table.merge(new) == []


def test_new_columns_edges_and_last_writes(spark, table, tmp_path):
    table.merge(spark.createDataFrame([(1, "en")], "uri long, lang string"))
    assert {r.lang for r in table.read().where("uri = 1").collect()} == {"en"} and table.read().count() == 200
    nodes = spark.createDataFrame([(k,) for k in range(5)], "uri long")
    edges = StoredTable.create(spark.createDataFrame([(0, "r", 1, "a")], "src long, rel_type string, dst long, note string"), str(tmp_path / "e"), ["src", "rel_type", "dst"], 4)
    edges.merge_edges(spark.createDataFrame([(0, "r", 1, "b"), (1, "r", 2, "c"), (1, "r", 9, "d")], "src long, rel_type string, dst long, note string"), nodes)
    assert content(edges) == [(0, "r", 1, "b"), (1, "r", 2, "c")]
    last = StoredTable.create(spark.createDataFrame([], "k long, x struct<ts:long,s:string>"), str(tmp_path / "l"), ["k"], 4)
    assert last.read() is None or last.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k long, ts long, s string").select("k", F.struct("ts", "s").alias("x"))
    last.merge_last(rows((1, 5, "a"), (2, 5, "b")), "x")
    last.merge_last(rows((1, 4, "late"), (2, 6, "c"), (3, 1, "d")), "x")
    assert {(r.k, r.x.s) for r in last.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert last.merge_last(rows((1, 4, "late")), "x") == []
