"""Nearest vectors against all pairs, and how many blocks are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import match as M


def brute(queries, vectors, k):
    out = set()
    x = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in enumerate([v for _, v in vectors])}
    for q, v in queries:
        u = np.array(v) / (np.linalg.norm(v) or 1)
        scores = sorted(((-round(float(u @ x[j]), 6), i) for j, (i, _) in enumerate(vectors) if i != q))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(scores[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)


def groups(n, dim, centres, seed):
    r = np.random.default_rng(seed)
    at = r.normal(size=(centres, dim))
    return [(k, (at[k % centres] + 0.05 * r.normal(size=dim)).round(3).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [16, 4096])
def test_topk_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(M, "VECTOR_BLOCK", block)
    monkeypatch.setattr(M, "QUERY_BLOCK", 8)
    rows = groups(300, 6, 9, 1)
    rows += [(500 + k, rows[3][1]) for k in range(40)] + [(600, [0.0] * 6), (601, (-np.array(rows[5][1])).tolist())]  # copies, zero, opposite
    queries = [r for r in rows if r[0] % 20 == 0]
    got = M.vector_topk(table(spark, queries), table(spark, rows), 7).collect()
    assert len(got) == 7 * len(queries)
    want = brute(queries, rows, 7)
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q, _, _, k in want}
    near = {(q, k): (v, s) for q, v, s, k in want}
    for r in got:
        v, s = near[r.query_id, r["rank"]]
        assert abs(r.score - s) < 2e-6 and (r.vec_id == v or abs(r.score - s) < 2e-6)


def test_few_and_no_vectors(spark):
    few = table(spark, [(1, [1, 0]), (2, [0, 1]), (20, [1, 1])])
    got = {(r.query_id, r.vec_id, r["rank"]) for r in M.vector_topk(few.where("vec_id = 20"), few, 5).collect()}
    assert got == {(20, 1, 1), (20, 2, 2)}
    none = few.where("vec_id < 0")
    assert M.vector_topk(none, few, 5).count() == 0 and M.vector_topk(few, none, 5).count() == 0


def test_bounds_hold_and_blocks_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(M, "VECTOR_BLOCK", 32)
    rows = groups(1200, 8, 30, 2)
    queries = table(spark, [r for r in rows if r[0] % 20 == 0])
    index = M.PivotBlocks(table(spark, rows))
    assert int(index.n.sum()) == 1200 and len(index.blocks) > 30
    x = {r.vec_id: (np.array(r.v), r.block) for r in index.rows.collect()}
    at = {b: k for k, b in enumerate(index.blocks.tolist())}
    for q in list(x)[:40]:
        u = x[q][0]
        most = M.highest_cosines(M._distances(u[None, :], index.pivots), index.low, index.high)[0]
        assert all(u @ v <= most[at[b]] for v, b in x.values())
    first = index.visits(queries, 5)
    found = index.search(first, 5).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False)[4].alias("kth"))
    met = first.count() + index.visits(queries, 5, found).count()
    share = met / (60 * len(index.blocks))
    print("share of (query, block) pairs formed:", round(share, 3))
    assert share < 0.4


def pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(M, "PAIR_BLOCK", block, raising=False)
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return M.vector_pairs(t.where("vec_id % 20 = 0"), t)


def test_pairs_of_zero_missing_and_opposite_vectors(spark, monkeypatch, tmp_path):
    import duckdb

    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in groups(130, 4, 5, 3)]
    rows[20], rows[40], rows[7], rows[8] = (20, [0.0] * 4), (40, None), (7, [0.0] * 4), (8, None)
    rows += [(200, [1.0, 0.0, 0.0, 0.0]), (201, [-1.0, 0.0, 0.0, 0.0]), (202, [-1e-8, 1.0, 0.0, 0.0]), (203, [0.0, 1.0, 0.0, 0.0]), (204, [-1e-6, 1.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/t")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/t/*.parquet'")
    from graphloom.plans import joins, registry  # noqa: F401

    plain = lambda found: sorted((q, v, repr(s)) for q, v, s in found)  # noqa: E731  tells -0.0, NaN and null apart
    want = plain(con.execute("select query_id, vec_id, score from (" + registry.SQL["j7_vector_pairs"] + ")").fetchall())
    for block in (4, 4096):  # 2 x 34 cells, and one
        got = plain((r.query_id, r.vec_id, r.score) for r in pairs(spark, monkeypatch, rows, block).collect())
        assert len(got) == 8 * 135 and got == want


def test_pairs_of_no_vectors(spark, monkeypatch):
    few = [(k, [1.0, 0.5 * k]) for k in range(3)]
    assert pairs(spark, monkeypatch, [], 8).count() == 0
    assert pairs(spark, monkeypatch, few[1:], 8).count() == 0
    assert [r.score for r in pairs(spark, monkeypatch, [(0, None), (1, []), (2, None)], 8).collect()] == [None] * 3
    t = spark.createDataFrame([(k, v * 2 if k == 1 else v) for k, v in few], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        M.vector_pairs(t, t).collect()


def test_a_task_has_one_cell_of_pairs_by_rising_score(spark, monkeypatch):
    rows = [(k, v) for k, v in groups(1000, 6, 9, 4)]
    found = pairs(spark, monkeypatch, rows, 250)
    cells = found.withColumn("task", F.spark_partition_id()).toPandas().groupby("task")  # in the order of rows
    assert len(cells) == found.rdd.getNumPartitions() == 4 and sum(len(c) for _, c in cells) == 50 * 1000
    for _, c in cells:
        assert c["score"].is_monotonic_increasing and len(c) == c["query_id"].nunique() * c["vec_id"].nunique() <= 50 * 300


def test_written_pairs_take_fewer_bytes_than_a_score(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(5)
    rows = [(k if k >= 400 else 20 * k + 100_000, v.tolist()) for k, v in enumerate(r.normal(size=(4000, 64)).astype(np.float32)) if k < 400 or k % 20]
    found = pairs(spark, monkeypatch, rows, 4096)
    found.write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n == 400 * len(rows)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 7 * n
