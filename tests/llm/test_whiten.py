"""Whitening against numpy's double-precision eigenvectors and exact integers."""

import math

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import whiten  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def symmetric(values, seed=1):
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.normal(size=(len(values), len(values))))[0]
    v = (q * values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("kind", ["apart", "near", "equal", "low"])
@pytest.mark.parametrize("dim", [1, 2, 7, 64])
def test_eigenvectors(dim, kind):
    values = np.sort(np.random.default_rng(dim).random(dim) * 100)[::-1].copy()
    half = dim // 2
    if kind == "near":
        values[:half] = 50 + 1e-9 * np.arange(half)  # single precision cannot tell these apart
    elif kind == "equal":
        values[:half] = 50
    elif kind == "low":
        values[half + 1 :] = 0
    v = symmetric(values)
    e, x = whiten.eigenvectors(v)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-12
    assert np.abs(v @ x - x * e).max() < 1e-12
    assert np.abs(x.T @ x - np.eye(dim)).max() < 1e-14


def test_single_precision_alone_would_not_do():
    v = symmetric(np.linspace(100, 1, 64))
    x32 = np.linalg.eigh(v.astype(np.float32))[1].astype(float)[:, ::-1]
    e, x = whiten.eigenvectors(v)
    assert np.abs(v @ x32 - x32 * e).max() > 1e-8 > 1e-12 > np.abs(v @ x - x * e).max()


def brute(rows, components=32):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    z = np.array([[v - t // n - (t % n) / n for v, t in zip(row, s, strict=True)] for row in x])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), row, c in zip(kept, x, z, strict=True):
        d = sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))
        for k in range(min(components, len(s))):
            out.setdefault((i, k + 1), []).append((n, d, abs(c @ u[:, k]) / math.sqrt(e[k]), e[k] / np.trace(v)))
    return out


def vectors(n, dim, seed=4):
    r = np.random.default_rng(seed)
    return [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(r.normal(size=(n, dim)) @ np.diag(np.linspace(3, 0.5, dim)))]


def test_against_numpy(spark):
    rows = vectors(300, 40) + [(900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [float("-inf")] + [0.0] * 39)]
    rows += rows[:40] + [(None, rows[7][1])]  # repeated rows count again
    want, got = brute(rows), {}
    for r in whiten.whiten(table(spark, rows)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert got.keys() == want.keys()
    for key, found in got.items():
        assert len(found) == len(want[key])
        for r, (n, d, white, share) in zip(found, want[key], strict=True):
            assert (r.n, r.deviation) == (n, d)
            assert abs(abs(r.whitened) - white) < 1e-9 and abs(r.explained - share) < 1e-12 and r.identity_error < 1e-9
    signs = {k: {np.sign(r.whitened) for i in range(20) for r in got[i, k]} for k in (1, 2)}
    assert all(len(s) == 2 for s in signs.values())  # one vector per component, so both signs occur


def test_other_lengths_constant_entries_and_large_ones(spark):
    rows = [(k, [k % 7, 5.0, 2 * (k % 7), (k * k) % 11]) for k in range(50)] + [(99, [1.0, 2.0]), (98, [1e30, 0, 0, 0])]
    got = whiten.whiten(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(50)) and len(got) == 200 and {r.n for r in got} == {50}
    # two directions vary, two do not
    assert all((r.whitened is None) == (r.component > 2) for r in got)
    assert all(r.identity_error < 1e-9 for r in got) and abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-12
    far = [(k, [2.0**40 * (k % 3), 1.0 * k]) for k in range(6)]
    wide = {r.vec_id: r.deviation for r in whiten.whiten(table(spark, far)).where("component = 1").collect()}
    assert wide == {k: (6 * 64 * k - 64 * 15) ** 2 if k % 3 == 1 else None for k in range(6)}  # the others are past a long
    one = whiten.whiten(table(spark, [(1, [3.0, 4.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]


def test_no_vectors(spark):
    assert whiten.whiten(table(spark, [])).count() == 0
    assert whiten.whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_query(spark, sf):
    from graphloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = QUERIES["op12_whiten"](spark, sf).collect()
    assert len(got) == len(want) == 32 * len(rows)
    for r in got:
        n, d, white, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, d) and abs(abs(r.whitened) - white) < 1e-8 and abs(r.explained - share) < 1e-10
    assert max(r.identity_error for r in got) < 1e-9
