"""Queries take all rows of their tables: against their SQL on small tables, and what their SQL must not leave out."""

import random

import duckdb

import __spark_entry__ as entry


def found(spark, name, table, path, *cols):
    """The rows of a query over one table, once they are those of its SQL."""
    table[1].write.parquet(f"{path}/{table[0]}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table[0]} as select * from '{path}/{table[0]}.parquet/*.parquet'")
    got = sorted(tuple(r[c] for c in cols) for r in entry.queries()[name](spark, str(path)).collect())
    assert got == sorted(con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall())
    return got


def test_partial_match_has_every_part_in_its_dictionary(spark, tmp_path):
    rows = [(1, "red ring", "LARGE", 1), (2, "kkk zzz", "PROMO", 1), (3, "old fyu", "STANDARD", 1), (4, "kkk fyu", "PROMO", 30), (5, "red qvw", "SMALL", 1)]
    part = spark.createDataFrame([(k, n, "Brand#1", t, s, 1.0) for k, n, t, s in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    # 1, 2 and 5 share no more than half of their characters with a label that is neither PROMO nor red
    assert found(spark, "j4_partial", ("part", part), tmp_path, "id", "concept") == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 1)]


def test_every_vector_is_a_context(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)], k % 4 if k % 15 else None) for k in range(1, 150)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(40)]  # copies, so equal scores
    rows += [(300, None, 1), (301, None, 8), (302, [1.0] * 6, 8), (303, None, 9), (304, None, 9), (305, [1.0] * 6, 10), (302, [-1.0] + [1.0] * 5, 2), (None, [1.0] * 6, 2)]
    rows += [(400, [0.0] * 6, 11), (401, [1.0] * 6, 11), (402, [2.0] + [1.0] * 5, 11), (403, None, 11)]  # zero: NaN, which is first in SQL
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = found(spark, "j30_disambiguation", ("embeddings", v), tmp_path, "id", "candidate")
    assert len(got) == len({i for i, _, label in rows if label is not None and i not in (None, 305)})
