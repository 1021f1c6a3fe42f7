"""Exact top-k inner-product search by ball trees.

The vectors are dealt into clusters and those into shards of bounded size, each with one ball tree that is built once. A
query first meets the shard whose root has its highest inner-product bound (q.c + |q| r), then the next best few, then
all others whose root bound still reaches its kth score; between these rounds the kth scores found are carried on.
Inside a tree a block of queries goes by branch and bound: nodes in the order of their bound, cut off by the kth scores.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import write_table

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF = 256
#: Centres that the vectors are dealt by: rows of the table, at most so many.
CENTRES = 256
#: Roots that a block of queries is held against at once.
ROOTS = 1024
#: Shards that a query meets in the second round, after the one of the first.
NEXT = 3
NONE = np.iinfo(np.int64).min


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q x' in whole numbers. Doubles where no sum can pass 2^53, Python's integers beyond; what a long cannot hold is cut
    to the nearest that it can (but never NONE, which stands for no row)."""
    size = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1).max(initial=0.0))
    if size(q) * size(x) < 2.0**53:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    whole = q.astype(object) @ x.astype(object).T
    return np.clip(whole, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def highest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id. Places with NONE are no rows."""
    low = ~scores  # orders from high to low, without overflow
    least = np.partition(low, k - 1, axis=1)[:, k - 1]
    keep = low <= least[:, None]
    width = int(keep.sum(axis=1).max())
    front = np.argsort(~keep, axis=1, kind="stable")[:, :width]
    low = np.take_along_axis(np.where(keep, low, ~NONE), front, axis=1)
    ids = np.take_along_axis(ids, front, axis=1)
    order = np.lexsort((ids, low), axis=1)[:, :k]
    return ~np.take_along_axis(low, order, axis=1), np.take_along_axis(ids, order, axis=1)


class BallTree:
    """Nodes over rows of ``x`` (whole numbers), split at the median along the direction of two far rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF):
        self.ids, self.x, self.rows = ids, x, ids if rows is None else rows
        real = x.astype(float)
        self.spans, self.centres, self.radii, self.kids = [], [], [], []
        self.index = np.arange(len(ids))
        stack = [(0, len(ids), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            rows = real[self.index[lo:hi]]
            centre = rows.mean(axis=0)
            node = len(self.spans)
            self.spans.append((lo, hi))
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if hi - lo > leaf and self.radii[-1] > 0:
                far = rows[((rows - centre) ** 2).sum(axis=1).argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                mid = (hi - lo) // 2
                self.index[lo:hi] = self.index[lo:hi][np.argpartition(rows @ (far - other), mid)]
                stack += [(lo + mid, hi, node), (lo, lo + mid, node)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each query's k best rows here; those below ``kth`` may be missing, and where there are fewer
        the score is NONE. The query's ``own`` row is left out."""
        top = np.full((len(q), k), NONE, np.int64)
        who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        floor = kth.copy()
        bound = root_bounds(q, self.centres, self.radii)
        turn = count()
        heap = [(-np.inf, next(turn), 0, np.arange(len(q)))]
        while heap:
            _, _, node, active = heapq.heappop(heap)
            active = active[bound[active, node] >= floor[active]]
            if not len(active):
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    ok = active[bound[active, kid] >= floor[active]]
                    if len(ok):
                        heapq.heappush(heap, (-float(bound[ok, kid].max()), next(turn), kid, ok))
                continue
            lo, hi = self.spans[node]
            rows = self.index[lo:hi]
            s = products(q[active], self.x[rows])
            s[own[active][:, None] == self.rows[rows][None, :]] = NONE
            better = (s >= np.maximum(floor[active], NONE + 1)[:, None]).any(axis=1)
            active, s = active[better], s[better]
            if len(active):
                held = np.concatenate([who[active], np.broadcast_to(self.ids[rows], s.shape)], axis=1)
                top[active], who[active] = highest(np.concatenate([top[active], s], axis=1), held, k)
                floor[active] = np.maximum(floor[active], top[active, -1])
        return top, who


def root_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of each query with any row of each ball, with room for rounding."""
    real = q.astype(float)
    norm = np.sqrt((real * real).sum(axis=1))[:, None]
    far = np.sqrt((centres * centres).sum(axis=1))[None, :] + radii[None, :]
    return real @ centres.T + norm * radii[None, :] + 1e-9 * norm * far + 1e-6


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, v, row: floor(scale * x) of each component, x as double, and a number of the row, which is the same for good only
    once it is written. Rows without a whole finite vector are left out."""
    x = F.col(vec_col).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(whole & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(rows: list, width: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r  # a shorter vector is as if it ended in zeros
    return out


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query (vec_id divisible by ``every``).

    All other rows are candidates, ties go to the smaller vec_id, and a query with fewer candidates gets them all.
    Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. Rows that repeat an
    id are rows of their own: each is a candidate, also of the others, and each asks, so its id has as many times k results.
    Vectors of different lengths are as if the shorter ended in zeros;
    an empty one scores 0. Components and scores beyond a long are cut to its ends. Other columns are not read; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    held = write_table(quantised(vectors, id_col, vec_col), "quantised")
    n, asked, width = held.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # clusters around some of the rows, then shards of about shard_rows within each
    some = held.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(CENTRES, -(-n // shard_rows))).collect()
    centres = _matrix([r.v for r in some], width, float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix([v.values.to_numpy(zero_copy_only=False) for v in batch.column("v")], width, float)
            away = (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(axis=1), pa.int64())], names=["vec_id", "v", "row", "cluster"])

    dealt = write_table(held.mapInArrow(nearest, "vec_id long, v array<long>, row long, cluster long"), "clusters")
    parts = dealt.groupBy("cluster").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))  # CENTRES rows at most
    shard = F.col("cluster") + CENTRES * F.pmod(F.xxhash64("row"), F.col("parts"))
    rows = dealt.join(F.broadcast(parts), "cluster").select(shard.alias("shard"), "vec_id", "v", "row")

    def build(key, t: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(t["vec_id"].to_numpy(), _matrix(list(t["v"]), width), t["row"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "centre": [tree.centres[0]], "radius": [tree.radii[0]], "tree": [pickle.dumps(tree, 5)]})

    trees = write_table(rows.groupBy("shard").applyInPandas(build, "shard long, centre array<double>, radius double, tree binary"), "trees")
    shards = trees.count()
    blocks = max(1, -(-asked // query_rows))
    # a query goes by the number of its row until the end
    queries = held.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query_id"), F.col("v").alias("q")).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)))

    def reached(asking: DataFrame, home: bool) -> DataFrame:
        """query_id, shard, bound: each query's best shard, or all others whose root bound reaches its ``kth``. The stated
        queries meet the roots, which are shards and not rows, block by block."""
        groups = -(-shards // ROOTS)
        roots = trees.select("shard", "centre", "radius", F.pmod("shard", F.lit(groups)).alias("group"))
        a = asking.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        r = roots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "shard": [], "bound": []}).astype({"query_id": "int64", "shard": "int64", "bound": "float64"})
            bound = root_bounds(_matrix(list(left["q"]), width), _matrix(list(right["centre"]), width, float), right["radius"].to_numpy())
            shard = right["shard"].to_numpy()
            at = (np.arange(len(left)), bound.argmax(axis=1)) if home else np.nonzero((bound >= left["kth"].to_numpy(np.int64)[:, None]) & (shard[None, :] != left["home"].to_numpy(np.int64)[:, None]))
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[at[0]], "shard": shard[at[1]], "bound": bound[at]})

        return a.groupBy("block", "group").cogroup(r.groupBy("block", "group")).applyInPandas(run, "query_id long, shard long, bound double")

    def look(asking: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the best rows of a shard for the queries (query_id, q, kth, shard) that ask there."""
        sizes = asking.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).alias("parts"))
        left = asking.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("parts")))
        right = trees.select("shard", "tree").join(sizes, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

        def run(key, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if not len(q):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            qid, kth = q["query_id"].to_numpy(), q["kth"].to_numpy(np.int64)
            top, who = pickle.loads(t["tree"].iloc[0]).search(_matrix(list(q["q"]), width), qid, k, kth)
            ok = (top > NONE) & (top >= kth[:, None])
            return pd.DataFrame({"query_id": np.repeat(qid, ok.sum(axis=1)), "vec_id": who[ok], "score": top[ok]})

        return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(run, schema)

    def kth_of(found: DataFrame) -> DataFrame:
        best = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k)
        return best.select("query_id", F.col("score").alias("kth"))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    start = queries.withColumn("kth", F.lit(int(NONE))).withColumn("home", F.lit(-1).cast("long"))
    home = reached(start, True).groupBy("query_id").agg(F.max(F.struct("bound", "shard")).alias("b")).select("query_id", F.col("b.shard").alias("home"))
    first_asked = write_table(queries.join(home, "query_id"), "first-asked")
    found = write_table(look(first_asked.select("query_id", "q", F.lit(int(NONE)).alias("kth"), F.col("home").alias("shard"))), "found")
    carry = lambda df, f: df.join(kth_of(f), "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(int(NONE))))
    asker = held.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("asker"))

    def top(df: DataFrame) -> DataFrame:
        best = df.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        return best.join(asker, F.col("query_id") == F.col("row")).select(F.col("asker").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    if shards == 1:
        return top(found)
    # what is left for a query, best bound first: the next few now, the others with the kth score that these give
    left = reached(carry(first_asked, found), False)
    left = write_table(left.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard"))), "left")
    vectors_of = first_asked.select("query_id", "q")
    second = look(carry(left.where(F.col("turn") <= NEXT).join(vectors_of, "query_id"), found).select("query_id", "q", "kth", "shard"))
    if shards <= NEXT + 1:
        return top(found.unionByName(second))
    second = write_table(second, "found")
    both = found.unionByName(second)
    rest = carry(left.where(F.col("turn") > NEXT), both).where(F.col("bound") >= F.col("kth")).join(vectors_of, "query_id")
    return top(both.unionByName(look(rest.select("query_id", "q", "kth", "shard"))))
