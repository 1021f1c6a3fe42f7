"""Steps whose tasks grow with the rows, so that a task's memory does not."""

from collections import Counter
from types import SimpleNamespace

from graphloom.operators import edges as E
from graphloom.operators import skew
from graphloom.operators import vote as V
from graphloom.plans import twins
from graphloom.sources import triples as TR


def test_related_edges_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 2)
    rows = spark.createDataFrame([(k % 7, k % 5) for k in range(60)], "l_suppkey long, l_partkey long")
    out = twins.related(SimpleNamespace(lineitem=rows))
    assert out.rdd.getNumPartitions() == 30 and out.count() == 35


def test_best_edges_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 2)
    rows = [(k % 7, 1, "PREREQUISITE" if k % 2 else None, float(k)) for k in range(60)]
    out = V.best_with_twin(spark.createDataFrame(rows, "src long, dst long, rel_type string, confidence double"))
    assert out.rdd.getNumPartitions() == 30
    best = {s: max((r for r in rows if r[0] == s), key=lambda r: r[3]) for s in range(7)}
    twin = [(s, d, t + "_ON", c) for s, d, t, c in best.values() if t]
    assert Counter(map(tuple, out.collect())) == Counter([*best.values(), *twin])


def test_lines_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 2)
    # a subject holds on over two blocks, one of which has none of its own; before it there is nothing to carry
    text = ["  k:partOf <o0> .", "<a> x", "  k:partOf <o1> ;", "  k:partOf <o2> ;", "  k:partOf <o3> .", "<b> x", "  k:partOf <o4> ."] + [""] * 33
    lines = spark.createDataFrame([("f", k // 3, k, s) for k, s in enumerate(text)], "file string, block long, seq long, text string")
    out = TR.linked_objects(lines)
    assert out.rdd.getNumPartitions() == 20
    assert sorted((r.subject, r.object) for r in out.collect()) == [("a", "o1"), ("a", "o2"), ("a", "o3"), ("b", "o4")]


def test_users_go_along_edges_in_lists(spark, monkeypatch):
    monkeypatch.setattr(E, "USERS", 2)
    have = [(u, n) for u in (*range(6), None) for n in range(4) if u is None or (u + n) % 3]
    edges = [(a, b) for a in range(4) for b in range(4, 9) if (a * b) % 4 != 1]
    seeds = spark.createDataFrame(have, "user long, node long")
    out = E.recommend(spark.createDataFrame(edges, "src long, dst long"), seeds, seeds.where("user < 0"), 99)
    want = Counter((u, b) for u, n in have for a, b in edges if a == n)
    assert {(r.user, r.node): r.ways for r in out.collect()} == want
    assert "users" in out._jdf.queryExecution().executedPlan().toString()
