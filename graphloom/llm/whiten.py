"""Whitening of vectors by the eigenvectors of their covariance.

Spark counts and sums the vectors, then adds up the products of the centred ones, a partial matrix a task. Of that
covariance, whose size is the dimension's alone, LAPACK gives eigenvectors in single precision, and the iteration of
Ogita and Aishima ("Iterative refinement for symmetric eigenvalue decomposition", parts I and II) corrects them by matrix
products: first in double, then in extended precision. Eigenvalues nearer to each other than the present error cannot be
told apart by it; each such cluster is solved by itself, shifted to its middle. A third pass measures what came out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries from this on give no x that a long holds.
MOST = 2.0**56
ITERATIONS = 12


def entries(batch: pa.RecordBatch, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which rows of ``batch`` have a vector without nulls and non-finite entries, and their floor(64 c)."""
    vectors = batch.column("vector")
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(lengths[lengths > 0]) if dim is None else [dim]:
        at = np.flatnonzero(lengths == size)
        c = pc.list_flatten(vectors.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        fit = (np.abs(c) < MOST).all(axis=1)  # false for what is null or not finite
        if fit.any():
            out[int(size)] = at[fit], np.floor(SCALE * c[fit]).astype(np.int64)
    return out


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors have the most frequent length (of equally frequent ones the greatest), and their exact sums."""

    def run(batches: Iterable[pa.RecordBatch]):
        found: dict[int, list] = {}
        for batch in batches:
            for size, (at, x) in entries(batch).items():
                n, s = found.setdefault(size, [0, [0] * size])
                wide = x.astype(object) if float(np.abs(x).max()) * len(x) >= 2.0**62 else x
                found[size] = [n + len(at), [a + int(b) for a, b in zip(s, wide.sum(axis=0), strict=True)]]
        for size, (n, s) in found.items():
            yield pa.record_batch({"size": pa.array([size] * size), "i": pa.array(range(size)), "n": pa.array([n] * size), "s": pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))})

    parts = rows.mapInArrow(run, "size long, i long, n long, s decimal(38,0)")
    total = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = total.where("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    return best["n"], [int(r["s"]) for r in total.where(F.col("size") == best["size"]).orderBy("i").collect()]


def products(rows: DataFrame, width: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Z'Z for all rows z that ``of`` makes of a batch. A task sends one partial row for each of the ``width`` dimensions;
    they are added while they are read, so that no group of them is held."""

    def partial(batches: Iterable[pa.RecordBatch]):
        total = np.zeros((width, width))
        for batch in batches:
            for part in pieces(batch, 4096):
                z = of(part)
                total += z.T @ z
        yield pa.record_batch({"i": pa.array(range(width)), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def added(batches: Iterable[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                total[i] = total.get(i, 0.0) + row.values.to_numpy()
        yield pa.record_batch({"i": pa.array(list(total), pa.int64()), "row": pa.array(list(total.values()), pa.list_(pa.float64()))})

    schema = "i long, row array<double>"
    found = rows.mapInArrow(partial, schema).repartition("i").mapInArrow(added, schema).collect()
    out = np.zeros((width, width))
    for i, row in found:
        out[i] = row
    return out


def clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Places of two or more values, each within ``width`` of the next one of its cluster."""
    order = np.argsort(values)
    ends = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [c for c in np.split(order, ends) if len(c) > 1]


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step in the precision of ``a``: better eigenvectors, their eigenvalues, and how much was corrected."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # a small gap would make much of a rounding that differs
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    # what two eigenvalues must differ by, to be told apart at the present error
    apart = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    gap = e[None, :] - e[:, None]
    near = np.abs(gap) <= apart
    step = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
    x = x + x @ step
    for c in clusters(e, apart):
        sub, shift = x[:, c], e[c].mean()
        small = sub.T @ (a @ sub - shift * sub)
        size = np.abs(small).max() or 1
        x[:, c] = sub @ np.linalg.eigh(((small + small.T) / (2 * size)).astype(float))[1].astype(a.dtype)
    return x, e, float(np.abs(step).max())


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric ``v``, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    scale = np.abs(v).max() or 1.0
    x = np.linalg.eigh((v / scale).astype(np.float32))[1].astype(float)
    for kind in (np.float64, np.longdouble):
        a, x, last = (v / scale).astype(kind), x.astype(kind), np.inf
        for k in range(ITERATIONS):
            x, _, moved = corrected(a, x)
            if moved < 4 * np.finfo(float).eps or (moved >= last and k > 3):  # a cluster that comes apart is corrected more at first
                break
            last = moved
    e = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-e, kind="stable")
    e, x = (e[order] * scale).astype(float), x[:, order].astype(float)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(e))])
    return e, x * sign


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Per row the sum of (n x - s)^2, exactly; null where a long cannot hold it."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    kind = np.int64 if largest**2 * len(s) < 2**63 else object
    d = n * x.astype(kind) - np.array(s, dtype=kind)
    return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and each of the first
    ``components`` components.

    Vectors that are null, empty or hold a null, a non-finite entry or one of 2^56 or more take no part, nor do those of
    another length than the most frequent one. Repeated rows count as often as they stand there, and a null id keeps its
    row. Where the vectors do not vary along a component (its eigenvalue is zero to rounding) ``whitened`` is null, and
    ``explained`` is null where nothing varies at all; ``identity_error`` is over the components that do. A deviation
    that a long cannot hold is null. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, s = sums(rows)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = len(s)
    # x and S without their offset, which cancels in every difference
    mean = np.array([v // n + (v % n) / n for v in s])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        found = entries(batch, dim)
        return found[dim][1] - mean if found else np.zeros((0, dim))

    v = products(rows, dim, centred) / n
    e, x = eigenvectors((v + v.T) / 2)
    k = min(components, dim)
    varies = e[:k] > dim * np.finfo(float).eps * max(e[0], 0.0)
    to_white = x[:, :k] / np.sqrt(np.where(varies, e[:k], np.nan))
    trace = float(np.trace(v))
    explained = [float(q) / trace if trace > 0 else None for q in e[:k]]

    # the column of ones gives the means of what is whitened, about which its covariance is
    def white_and_one(batch: pa.RecordBatch) -> np.ndarray:
        z = centred(batch) @ to_white[:, varies]
        return np.hstack([z, np.ones((len(z), 1))])

    error = 0.0
    if varies.any():
        g = products(rows, int(varies.sum()) + 1, white_and_one) / n
        error = float(np.abs(g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) - np.eye(len(g) - 1)).max())

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, 2048):
            found = entries(part, dim)
            if found:
                at, whole = found[dim]
                white = ((whole - mean) @ to_white).ravel()
                take = pa.array(np.repeat(np.arange(len(at)), k))
                yield {
                    "vec_id": part.column("vec_id").take(pa.array(at)).take(take),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                    "n": np.full(len(at) * k, n),
                    "deviation": pa.array(deviations(whole, n, s), pa.int64()).take(take),
                    "whitened": pa.array(white, mask=np.isnan(white)),
                    "explained": pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(at)))),
                    "identity_error": np.full(len(at) * k, error),
                }

    return map_batches(rows, run, schema)
