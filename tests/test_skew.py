"""Joins and pairs where one key, beginning or group holds most rows; results are those of all pairs tried."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import match as M
from graphloom.operators import skew


def test_dealt_keys_join_as_always(spark):
    many = spark.createDataFrame([(k, "hot" if k % 10 else f"k{k}") for k in range(300)] + [(999, None)], "id long, key string").repartition(3)
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4), (None, 5)], "key string, v int")
    want = sorted(map(tuple, many.join(few, "key").select("key", "id", "v").collect()))
    got = skew.join_dealt(many, few, "key", F.col("id"), size=40)
    assert sorted(map(tuple, got.select("key", "id", "v").collect())) == want and got.columns == ["key", "id", "v"]
    assert skew.parts(many, "key", 40).collect()[0][1] == 7


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_pairs_within_groups(spark, size):
    r = random.Random(size)
    rows = [("big", r.randrange(60)) for _ in range(90)] + [(f"g{k % 9}", k) for k in range(30)] + [(None, 1), (None, 2), ("g1", None)]
    got = skew.pairs_within(spark.createDataFrame(rows, "g string, x long").repartition(3), "g", F.col("x"), size).collect()
    groups = {}
    for g, x in rows:
        if g is not None and x is not None:
            groups.setdefault(g, set()).add(x)
    assert sorted(map(tuple, got)) == sorted((g, a, b) for g, xs in groups.items() for a in xs for b in xs if a < b)


def test_a_chapter_with_half_of_all_points(spark, monkeypatch):
    points = [("all", k % 20, k) for k in range(200)] + [(f"c{k % 40}", k % 5, 1000 + k) for k in range(200)]
    df = spark.createDataFrame(points, "chapter string, pos long, point long").repartition(4)
    want = {(a[2], b[2]) for a in points for b in points if a[0] == b[0] and a[1] < b[1]}
    monkeypatch.setattr(skew, "PAIR_ROWS", 16)
    assert {tuple(r) for r in E.teaches_before(df).collect()} == want
    kinds = spark.createDataFrame([(c, p, pt % 3) for c, p, pt in points], "g string, node long, kind long")
    rows = {(c, p, pt % 3) for c, p, pt in points}
    assert {tuple(r) for r in E.other_kinds(kinds, "g", "node", "kind").collect()} == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and a[1] < b[1]}


def labels(n, seed, begin="chapter on "):
    r = random.Random(seed)
    return [(begin if r.random() < 0.9 else "") + "".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(n)] + ["", "a", None, "ABC"]


@pytest.mark.parametrize("size", [5, 100_000])
def test_containment_when_most_labels_begin_alike(spark, monkeypatch, size):
    monkeypatch.setattr(skew, "KEY_ROWS", size)
    a, b = labels(60, 1), labels(50, 2)
    items = spark.createDataFrame(list(enumerate(a)), "id long, label string")
    concepts = spark.createDataFrame([(k, x, 100 - k) for k, x in enumerate(b)], "concept long, label string, ord long")
    want = {}
    for i, x in enumerate(a):
        hits = [(100 - k, k) for k, y in enumerate(b) if x and y and (x.lower() in y.lower() or y.lower() in x.lower())]
        if hits:
            want[i] = min(hits)[1]
    got = M.containment(items, concepts).collect()
    assert len(got) == len(want) and {r.id: r.concept for r in got} == want
    texts = spark.createDataFrame([(k, None if x is None else f"{x} and {a[k - 1]}") for k, x in enumerate(a)], "id long, definition string")
    names = spark.createDataFrame([(x,) for x in b], "name string")
    found = {(r.id, r["name"]) for r in M.mentions(texts, names).collect()}
    assert found == {(r.id, y) for r in texts.collect() if r.definition for y in b if y and len(y) >= 3 and y.lower() in r.definition.lower()}


def test_few_grams_are_frequent_in_the_lookup(spark):
    items = spark.createDataFrame([(k, f"the same beginning {k:04d}") for k in range(400)], "id long, label string")
    rows = M.gram_rows(items, "label", 3)
    met = M.filed(items.select(F.col("label").alias("b")), "b", rows, 3)
    often = rows.groupBy("g").agg(F.count("*").alias("n"))
    assert met.count() == 400 and met.join(often, "g").agg(F.max("n")).first()[0] <= 40  # the beginning is in 400


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def edited(r, text, n):
    for _ in range(n):
        k, c = r.randrange(len(text) + 1), r.choice("abé字")
        text = r.choice([text[:k] + c + text[k:], text[:k] + text[k + 1 :], text[:k] + c + text[k + 1 :]])
    return text


@pytest.mark.parametrize("size", [4, 100_000])
def test_fuzzy_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(skew, "KEY_ROWS", size)
    r = random.Random(5)
    d = ["".join(r.choice("abé字") for _ in range(r.randint(0, 11))) for _ in range(120)] + ["x" * 40, "", "aaaaaaaaaa"]
    asked = [edited(r, x, r.randint(0, 3)) for x in d] + ["zzzzzz", "", None]
    items = spark.createDataFrame(list(enumerate(asked)), "id long, label string")
    want = {}
    for k, x in enumerate(asked):
        if x is not None:
            most = 0 if len(x) <= 2 else 1 if len(x) <= 5 else 2
            near = [(e, y) for y in set(d) if (e := distance(x, y)) <= most]
            if near:
                want[k] = min(near, key=lambda n: (n[0], n[1].encode()))
    got = M.fuzzy(items, spark.createDataFrame([(x,) for x in d] + [(None,)], "label string")).collect()
    assert len(got) == len(want) and {x.id: (x.distance, x.match) for x in got} == want


def test_fuzzy_of_long_labels_has_few_keys(spark):
    r = random.Random(6)
    d = ["".join(r.choice("abcdef") for _ in range(500)) for _ in range(30)]
    items = spark.createDataFrame([(k, edited(r, x, 2)) for k, x in enumerate(d)], "id long, label string")
    assert items.select(F.max(F.size(M.segment_probes(F.col("label"), 2)))).first()[0] <= 19
    got = M.fuzzy(items, spark.createDataFrame([(x,) for x in d], "label string")).collect()
    assert {x.id: x.match for x in got} == dict(enumerate(d))


def test_semantic_step_of_the_cascade(spark):
    items = spark.createDataFrame([(1, "alpha"), (2, "alphabet soup"), (3, "zeta"), (4, "eta9"), (5, "none")], "id long, label string")
    concepts = spark.createDataFrame([(10, "alpha", 1), (11, "omega", 2), (12, "psi", 3)], "concept long, label string, ord long")
    answers = spark.createDataFrame([(1, 11, 0.9), (3, 12, 0.7), (3, 11, 0.7), (4, 11, 0.71), (4, 12, 0.9), (5, 99, 0.9), (5, 11, None)], "id long, concept long, similarity double")
    got = {r.id: (r.concept, r.match_type, r.confidence) for r in M.cascade(items, concepts, answers).collect()}
    assert got == {1: (10, "exact", 1.0), 2: (10, "contains", 0.8), 3: (11, "semantic", 0.7), 4: (12, "semantic", 0.7), 5: (None, "new", 1.0)}


def test_pairs_of_one_label_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIR_ROWS", 20)
    a = spark.createDataFrame([(k, "x") for k in range(90)] + [(500, "y"), (501, None)], "uri long, label string")
    b = spark.createDataFrame([(k, "x") for k in range(50, 150)] + [(500, "y"), (502, "y"), (503, None)], "uri long, label string")
    rows = E.same_label(a, b)
    got = [tuple(r) for r in rows.collect()]
    assert sorted(got) == sorted([("x", i, j) for i in range(90) for j in range(50, 150) if i != j] + [("y", 500, 502)])
    assert len({r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}) > 4


def test_partial_looks_up_labels_with_the_same_characters_once(spark, monkeypatch):
    met, dealt = [], M.join_dealt
    monkeypatch.setattr(M, "join_dealt", lambda many, few, key, by, size=None: met.append((key, many, few)) or dealt(many, few, key, by, size))
    items = spark.createDataFrame([(k, ("abcde", "edcba", "qrs")[k % 3]) for k in range(60)], "id long, label string")
    concepts = spark.createDataFrame([(k, ("abcxy", "yxcba", "zzz")[k % 3], 100 - k) for k in range(30)], "concept long, label string, ord long")
    assert {tuple(r) for r in M.partial(items, concepts).collect()} == {(k, 28) for k in range(60) if k % 3 < 2}
    (many, few), *_ = [(m, f) for key, m, f in met if key == "ch"]
    assert many.count() == 5 + 1 and few.select("a").distinct().count() == 2  # sets, not rows


def test_nearest_in_group_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERY_BLOCK", 7)
    monkeypatch.setattr(M, "VECTOR_BLOCK", 9)
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(5)], k % 3 if k else None) for k in range(80)] + [(90, None, 1), (91, [0.0] * 5, 7)]
    v = spark.createDataFrame(rows, "id long, v array<float>, label long")
    got = {tuple(x) for x in M.nearest_in_group(v, v.withColumnRenamed("id", "candidate"), "label").collect()}
    pairs = v.alias("a").join(v.alias("b"), "label").where("a.id <> b.id").select("a.id", F.col("b.id").alias("candidate"), "b.v")
    assert got == {tuple(x) for x in M.disambiguate(v.select("id", "v"), pairs).collect()} and len(got) == 79


def test_few_names_are_looked_for_without_grams(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    d = spark.createDataFrame([(1, "The Red ring and a blue one"), (2, None), (3, "nothing"), (1, "red")], "id long, definition string")
    n = spark.createDataFrame([("red",), ("Blue",), ("on",), ("RED",), (None,)], "name string")
    monkeypatch.setattr(M, "FEW_NAMES", 0)
    want = sorted(map(tuple, M.mentions(d, n).collect()))
    monkeypatch.setattr(M, "FEW_NAMES", 64)
    monkeypatch.setattr(M, "filed", never)
    assert sorted(map(tuple, M.mentions(d, n).collect())) == want == [(1, "Blue"), (1, "RED"), (1, "red")]
