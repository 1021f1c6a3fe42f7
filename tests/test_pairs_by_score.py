"""Pairs of vectors that several tasks give, each those of some scores."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graphloom.operators import match as M
from graphloom.plans import joins, registry  # noqa: F401


def by_score(monkeypatch, scores, share):
    monkeypatch.setattr(M, "SCORES", scores, raising=False)
    monkeypatch.setattr(M, "LEAST_SHARE", share, raising=False)


def test_no_pair_is_lost_or_changed_where_pairs_are_cut_by_score(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "PAIR_BLOCK", 50)
    by_score(monkeypatch, 10, 0.05)
    r = np.random.default_rng(6)
    rows = [(k, r.normal(size=4).astype(np.float32).tolist()) for k in range(200)]
    rows[20], rows[40], rows[7], rows[8] = (20, [0.0] * 4), (40, None), (7, [0.0] * 4), (8, None)
    rows += [(200, [1.0, 0.0, 0.0, 0.0]), (201, [-1.0, 0.0, 0.0, 0.0]), (202, [-1e-8, 1.0, 0.0, 0.0]), (203, [0.0, 1.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/t")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/t/*.parquet'")
    plain = lambda found: sorted((q, v, repr(s)) for q, v, s in found)  # noqa: E731  tells -0.0, NaN and null apart
    t = spark.read.parquet(f"{tmp_path}/t")
    found = M.vector_pairs(t.where("vec_id % 20 = 0"), t).withColumn("task", F.spark_partition_id()).collect()
    want = plain(con.execute("select query_id, vec_id, score from (" + registry.SQL["j7_vector_pairs"] + ")").fetchall())
    assert len(found) == 11 * 204 and plain((x.query_id, x.vec_id, x.score) for x in found) == want
    ends = {}
    for x in found:
        if x.score is not None and x.score == x.score:
            ends.setdefault(x.task // 5, []).append(x.score)  # five cells
    spans = sorted((min(s), max(s)) for s in ends.values())
    assert 10 < len(spans) <= 20 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_scores_of_a_task_fit_a_parquet_dictionary(spark, monkeypatch, tmp_path):
    by_score(monkeypatch, 4000, 0.005)
    r = np.random.default_rng(7)
    rows = [(20 * k if k < 400 else 20 * k + 1, (1 + 0.3 * r.normal(size=64)).astype(np.float32).tolist()) for k in range(4000)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    # a dictionary of 4400 values instead of 131,072
    M.vector_pairs(t.where("vec_id % 20 = 0"), t).write.option("parquet.dictionary.page.size", 8 * 4400).parquet(f"{tmp_path}/pairs")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    scores = [(m.num_rows, "PLAIN" in m.row_group(0).column(2).encodings) for m in files if m.num_rows]
    assert sum(n for n, _ in scores) == 400 * 4000
    assert sum(n for n, outside in scores if not outside) > 0.9 * 400 * 4000
