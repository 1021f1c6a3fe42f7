"""Fill-in-the-middle against a version in plain Python, and SQL."""

import hashlib
import random

import pytest

pytest.importorskip("graphloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from graphloom.llm import fim  # noqa: E402


def expected(doc_id, text, seed="1"):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", t
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", t


def rows():
    r = random.Random(3)
    # parts of markers stand next to the cuts, and code points have one to four bytes
    pieces = ["<", "<S", "<P", "M>", ">", "S>", "a", "é", "字", "😀", "\n", " ", "é", "\u0000"]
    out = [(k, "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for k in range(400)]
    out += [(-7, "minus"), (None, "no id, twice"), (None, "no id, twice"), (401, None), (402, ""), (403, "has <M> inside"), (404, "x" * 300_000 + "é"), (5, "an id with another text"), (404, "y")]
    return out


def test_every_form_is_cut_and_rebuilt(spark):
    docs = spark.createDataFrame([(i, t, 3, "clash") for i, t in rows()], "doc_id long, text string, n int, output string").repartition(3)
    out = fim.fill_in_middle(docs)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in rows()), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_columns_seeds_and_no_rows(spark):
    docs = spark.createDataFrame([(k, "abcdefghij" * k) for k in range(60)], "k int, body string")
    got = fim.fill_in_middle(docs, "k", "body", seed="s").select("doc_id", "output").collect()
    assert sorted(map(tuple, got)) == sorted((k, expected(k, "abcdefghij" * k, "s")[5]) for k in range(60))
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slices_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    texts = ["a" * k for k in (0, 9, 1, 1, 30, 0, 2)]
    parts = list(fim._slices(pa.record_batch({"text": pa.array(texts)}), "text", 8))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 8 for p in parts)
    p = parts[-1].column("text")
    assert fim.units(p).to_pylist() == [list(t) for t in p.to_pylist()]


def test_query_against_sql(spark, sf):
    import duckdb

    from graphloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op13_fim"])
    names = [c[0] for c in want.description]
    got = QUERIES["op13_fim"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
