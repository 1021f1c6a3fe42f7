"""Label, set and vector matching (J1-J10, J21, J26-J30, J41, W6, V12). Every first-match rule breaks ties by an explicit order."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import drop_table, write_table
from .skew import cells, join_dealt

#: Dictionaries up to this many rows are broadcast; larger ones are joined by shuffle.
SMALL = 200_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcast ``df`` only after its rows have been counted."""
    return F.broadcast(df) if df.count() <= most else df


def exact(items: DataFrame, dictionary: DataFrame, key: str = "label") -> DataFrame:
    """Items with ``matched``."""
    d = dictionary.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    return items.join(d, items[key] == d["__k"], "left").withColumn("matched", F.col("__k").isNotNull()).drop("__k")


def by_synonyms(items: DataFrame, concepts: DataFrame, synonyms: Mapping[str, list[str]], order: str = "ord") -> DataFrame:
    """(id, label, concept): equality of normal labels. A label that is a word of the table, or one of its synonyms,
    also stands for that word and all its synonyms; the concept first in ``order`` wins; null without a match.
    items (id, label), concepts (concept, label, ord)."""
    spark = items.sparkSession
    pairs = [(a, b) for word, others in synonyms.items() for a in (word, *others) for b in (word, *others) if a != b]
    raw = spark.createDataFrame(pairs or [("", "")], "word string, other string")
    table = raw.select(T.normal_label(F.col("word")).alias("word"), T.normal_label(F.col("other")).alias("other")).distinct()
    keys = items.select("id", T.normal_label(F.col("label")).alias("word")).distinct()
    expanded = keys.select("id", "word").unionByName(keys.join(F.broadcast(table), "word").select("id", F.col("other").alias("word"))).where("word <> ''").distinct()
    c = concepts.select("concept", T.normal_label(F.col("label")).alias("word"), F.col(order).alias("ord")).groupBy("word").agg(F.min(F.struct("ord", "concept")).alias("c"))
    hit = expanded.join(c, "word").groupBy("id").agg(F.min("c").alias("c"))
    return items.join(hit, "id", "left").select("id", "label", F.col("c.concept").alias("concept"))


def grams(label: Column, n: int) -> Column:
    """All distinct runs of ``n`` characters of a label, in one pass over it; the label itself if it is shorter."""
    return F.when(F.char_length(label) < n, F.array(label)).otherwise(F.array_distinct(F.regexp_extract_all(label, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)))


def gram_rows(rows: DataFrame, label: str, n: int) -> DataFrame:
    """``rows`` once for each of the distinct runs of 1 to ``n`` characters of ``label``, as ``g``."""
    runs = [F.when(F.char_length(label) >= k, grams(F.col(label), k)).otherwise(F.array().cast("array<string>")) for k in range(1, n + 1)]
    return rows.select("*", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("g"))


def filed(needles: DataFrame, needle: str, hay: DataFrame, n: int) -> DataFrame:
    """``needles`` with ``g``: of the grams of each the one that the fewest rows of ``hay`` (g) have. One that has a gram which none
    of them has is in no text, so it goes. ``needle`` tells the rows apart."""
    often = hay.groupBy("g").agg(F.count("*").alias("often"))
    own = needles.select(F.col(needle).alias("__needle"), F.explode(grams(F.col(needle), n)).alias("g"))
    best = own.join(often, "g", "left").groupBy("__needle").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")).alias("f"))
    return needles.join(best.where("f.often > 0"), F.col(needle) == F.col("__needle")).select(*needles.columns, F.col("f.g").alias("g"))


def held(hay: DataFrame, text: str, needles: DataFrame, needle: str, by: str, n: int = 3) -> DataFrame:
    """``hay`` joined with ``needles`` where the text holds the needle.

    A text that holds a needle has all its grams (runs of ``n`` characters, or all of a shorter one), so a needle is filed under
    its rarest, and meets the texts with that one only; ``contains`` decides. Common beginnings therefore gather nothing. The
    texts of a gram that even as the rarest of a needle is frequent are dealt into parts by ``by``.
    """
    rows = gram_rows(hay, text, n)
    return join_dealt(rows, filed(needles, needle, rows, n), "g", F.col(by)).where(F.contains(text, needle)).drop("g")


def containment(items: DataFrame, concepts: DataFrame, n: int = 3) -> DataFrame:
    """(id, concept, confidence 0.8): either label holds the other; the concept first in ``ord`` wins."""
    i = items.select("id", F.lower("label").alias("a")).where("a <> ''")
    # of concepts with one label only the first can win; items with one label have one answer
    c = concepts.select(F.lower("label").alias("b"), F.struct("ord", "concept").alias("c")).where("b <> ''").groupBy("b").agg(F.min("c").alias("c"))
    a = i.select("a").distinct()
    hits = held(a, "a", c, "b", "a", n).select("a", "c").unionByName(held(c, "b", a, "a", "b", n).select("a", "c"))
    best = hits.groupBy("a").agg(F.min("c").alias("c"))
    return i.join(best, "a").groupBy("id").agg(F.min("c").alias("c")).select("id", F.col("c.concept").alias("concept"), F.lit(0.8).alias("confidence"))


def partial(items: DataFrame, concepts: DataFrame, share: float = 0.5) -> DataFrame:
    """(id, concept): containment, or more than ``share`` of the distinct characters shared; the smallest ord wins.

    Of k characters more than share * k are shared only if one of any k - floor(share * k) of them is, so an item is
    looked up by that many of its characters, those that the fewest concepts have. No pair is lost by that, and
    the commonest characters are hardly looked up. Unicode bounds the table of characters that is broadcast. Labels with
    the same characters are looked up once, and the sets of concepts under a frequent character are dealt into parts.
    """
    chars = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))
    c = concepts.select(chars(F.col("label")).alias("b"), F.struct("ord", "concept").alias("c")).groupBy("b").agg(F.min("c").alias("c"))
    of = items.select("id", chars(F.col("label")).alias("a"))
    often = c.select(F.explode("b").alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    # (n, ch) pairs in order, without a group per item: the counts come as one map
    counts = often.agg(F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("counts"))
    i = of.select("a").distinct().crossJoin(F.broadcast(counts))  # one row
    ranked = F.array_sort(F.transform("a", lambda x: F.struct(F.coalesce(F.try_element_at("counts", x), F.lit(0)).alias("n"), x.alias("ch"))))
    least = F.size("a") - F.floor(F.size("a") * share).cast("int")
    asked = i.select("a", F.explode(F.slice(ranked, F.lit(1), F.greatest(least, F.lit(1)))["ch"]).alias("ch")).where("size(a) > 0")
    both = join_dealt(c.select("b", "c", F.explode("b").alias("ch")), asked, "ch", F.col("b")).where(F.size(F.array_intersect("a", "b")) / F.size("a") > share)
    best = both.groupBy("a").agg(F.min("c").alias("c"))
    hits = of.join(best, "a").select("id", "c.ord", "c.concept").unionByName(containment(items, concepts).join(concepts, "concept").select("id", "ord", "concept"))
    return hits.groupBy("id").agg(F.min_by("concept", F.struct("ord", "concept")).alias("concept"))


def cascade(items: DataFrame, concepts: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(id, label, concept, match_type, confidence): exact 1.0, else contains 0.8, else semantic 0.7, else new with 1.0.

    The semantic step takes given ``answers`` (id, concept, similarity): recorded decisions of a model, or the hits of
    ``vector_topk`` at or above a gate. The most similar one counts, of equals the concept first in ``ord``.
    """
    c = concepts.groupBy("label").agg(F.min(F.struct("ord", "concept")).alias("c"))
    one = items.join(c, "label", "left").select("id", "label", F.col("c.concept").alias("e"))
    rest = one.where("e is null").select("id", "label")
    two = containment(rest, concepts).select("id", F.col("concept").alias("k"))
    out = one.join(two, "id", "left")
    if answers is None:
        out = out.withColumn("s", F.lit(None).cast(concepts.schema["concept"].dataType))
    else:
        known = concepts.groupBy("concept").agg(F.min("ord").alias("ord"))
        three = answers.where("similarity is not null").join(known, "concept").groupBy("id").agg(F.min(F.struct(-F.col("similarity"), "ord", "concept")).alias("a"))
        out = out.join(three.select("id", F.col("a.concept").alias("s")), "id", "left")
    steps = [("e", "exact", 1.0), ("k", "contains", 0.8), ("s", "semantic", 0.7)]
    first = lambda at, rest: F.coalesce(*[F.when(F.col(step[0]).isNotNull(), F.lit(step[at])) for step in steps], F.lit(rest))
    return out.select("id", "label", F.coalesce("e", "k", "s").alias("concept"), first(1, "new").alias("match_type"), first(2, 1.0).alias("confidence"))


#: Queries and vectors that meet in one task at once.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


#: Queries, and vectors, that meet in a task of J7 on average: hardly ever more than the 8192 whose places take 13 bits in a Parquet
#: dictionary. The task sorts those of their pairs that it gives (8 bytes each, 504 MB if it gives all); so many leave it at once.
PAIR_BLOCK, PAIRS_OUT = 7936, 1 << 16
#: Scores side by side that one task gives: a Parquet dictionary of Spark's usual size, 1 MB, holds 131,072.
SCORES = 125_000
#: Queries and vectors whose cosines say where pairs are cut by score, the least share of them in a task, and the pairs for each of SCORES
#: from which that saves bytes.
SAMPLE, LEAST_SHARE, WORTH = (256, 512), 0.005, 32
#: What stands for a score that is NaN, and for none, among whole numbers of millionths.
NOT_A_NUMBER, NO_SCORE = 1_000_002, 1_000_003


def _units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column, each of length 1 (NaN where its length is zero), and which of them are there at all."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    there = sizes > 0
    if (sizes[there] != width).any():
        raise ValueError("vectors of different lengths have no cosine")
    m = np.ones((len(sizes), width))
    m[there] = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(there.sum()), width)
    with np.errstate(invalid="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True)), there


def _sorted_pairs(x: np.ndarray, x_there: np.ndarray, y: np.ndarray, y_there: np.ndarray, lowest: float = -np.inf, below: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of a row of ``x`` and one of ``y`` by rising score, in pieces: the rows' numbers, the scores, and which have none. All
    of them, or those of ``lowest`` millionths or more that are ``below`` others.

    A pair is one whole number: its score, then the two rows' numbers. A score below zero, or of -0.0, counts as one millionth less.
    """
    n, m = len(x), len(y)
    low, high = m.bit_length(), m.bit_length() + n.bit_length()
    special = [(NOT_A_NUMBER, np.isnan(x).any(axis=1), np.isnan(y).any(axis=1)), (NO_SCORE, ~x_there, ~y_there)]
    places = (np.arange(min(n, 128)) << low)[:, None] + np.arange(m)
    keys, filled = np.empty(n * m, np.int64), 0  # what is not filled takes no memory
    for at in range(0, n, 128):
        with np.errstate(invalid="ignore"):
            s = x[at : at + 128] @ y.T
        s *= 1e6
        for value, rows, columns in special:
            s[rows[at : at + 128]], s[:, columns] = value, value
        # at the ends a little too many, until they are rounded
        near = (s >= lowest - 2) & (s < below + 2)
        k = np.rint(s[near])
        k -= np.signbit(k)
        inside = (k >= lowest) & (k < below)
        k = k[inside].astype(np.int64)
        k <<= high
        k += places[: len(s)][near][inside] + (at << low)
        keys[filled : filled + len(k)] = k
        filled += len(k)
    keys = keys[:filled]
    keys.sort()
    for at in range(0, len(keys), PAIRS_OUT):
        k = keys[at : at + PAIRS_OUT] >> high
        pair = keys[at : at + PAIRS_OUT] & ((1 << high) - 1)
        zero, last = np.searchsorted(k, [0, NOT_A_NUMBER])
        score = k / 1e6
        score[:zero] = -((-1 - k[:zero]) / 1e6)
        score[last:] = np.nan
        yield pair >> low, pair & ((1 << low) - 1), score, k == NO_SCORE


def _score_cuts(q: DataFrame, v: DataFrame) -> list[int]:
    """Millionths at which the pairs are dealt by score, so that a task has ``SCORES`` of them or little more. A sample tells where there are
    enough pairs for that; no pair is lost by it, nor its score changed."""
    few = [df.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(n).collect() for df, n in zip((q, v), SAMPLE, strict=True)]
    lists = [pa.array([r["v"] for r in rows], pa.list_(pa.float64())) for rows in few]
    x, y = (_units(rows, max((len(r["v"]) for rows in few for r in rows), default=0))[0] for rows in lists)
    s = (x @ y.T).ravel()
    bands, n = np.unique(np.floor(s[~np.isnan(s)] * 1e6 / SCORES).astype(int), return_counts=True)
    cuts, held, rest, least = [], 0, n.sum(), LEAST_SHARE * n.sum()
    for band, count in zip(bands.tolist(), n.tolist(), strict=True):
        if held >= least and rest >= least:
            cuts.append(band * SCORES)
            held = 0
        held, rest = held + count, rest - count
    return cuts


def vector_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): cosine of each stated query with each vector, rounded to 6 digits; NaN where one is all
    zeros, null where one is missing.

    The result has a row for every pair, so it is quadratic. A part of the queries and a part of the vectors, of the same size
    however many there are, meet in a task as matrices, and their pairs leave it in pieces by rising score: like that, equal
    scores stand together and take up little when they are written. Where a task would have many pairs and more scores than a
    Parquet dictionary holds, several tasks read the same parts, and each gives the pairs of some scores.
    """
    kind = "array<float>" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (queries, vectors)) else "array<double>"
    q, v = (df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")) for df in (queries, vectors))
    sizes = [df.count() for df in (q, v)]
    rows, cols = (max(1, -(-n // PAIR_BLOCK)) for n in sizes)
    most = PAIR_BLOCK + PAIR_BLOCK // 4
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "v", F.lit(True).alias("asked"), own(rows, 1).alias("i"), each(cols).alias("j"))
    right = v.select("id", "v", F.lit(False).alias("asked"), each(rows).alias("i"), own(cols, 2).alias("j"))

    def between(lowest: float, below: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = pa.Table.from_batches(list(batches))
            width = pc.max(pc.list_value_length(met["v"])).as_py() or 0
            sides = []
            for some in (met.filter(met["asked"]), met.filter(pc.invert(met["asked"]))):
                # one piece, as hashes deal rows evenly, unless many have one id
                sides.append([(x["id"].combine_chunks(), *_units(x["v"].combine_chunks(), width)) for x in (some.slice(at, most) for at in range(0, len(some), most))])
            for q_ids, x, x_there in sides[0]:
                for v_ids, y, y_there in sides[1]:
                    for a, b, score, none in _sorted_pairs(x, x_there, y, y_there, lowest, below):
                        yield pa.record_batch([q_ids.take(pa.array(a)), v_ids.take(pa.array(b)), pa.array(score, mask=none, from_pandas=False)], names=["query_id", "vec_id", "score"])

        return run

    ends = [-np.inf, *(_score_cuts(q, v) if sizes[0] * sizes[1] > WORTH * rows * cols * SCORES else []), np.inf]
    # two partitions at least where scores are cut: Spark unites frames of one partition in one task
    met = left.unionByName(right).select("id", "v", "asked", (F.col("i") * cols + F.col("j")).alias("cell")).repartitionById(max(rows * cols, min(2, len(ends) - 1)), "cell")
    # the parts are dealt once, for all scores
    found = [met.groupBy("cell").applyInArrow(between(*pair), "query_id long, vec_id long, score double") for pair in itertools.pairwise(ends)]
    return functools.reduce(DataFrame.unionAll, found)


#: Cells of queries and a block of vectors in a task, some 2.5 MB each at 64 dimensions.
CELLS = 8
#: Vectors that all others keep their distances to, the width of a ring around one, and the most blocks but one for each ring.
PIVOTS, RING, MOST_BLOCKS = 16, 0.05, 16_384


def _matrix(column: pd.Series) -> np.ndarray:
    """The vectors of a column, each of length 1; zero vectors stay as they are."""
    m = np.stack(list(column))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T), 0.0))


def highest_cosines(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No cosine of a query, at distances ``d`` (queries x pivots), with a vector of a block, between ``low`` and ``high`` (blocks x
    pivots), is above this (queries x blocks). The allowance is for rounding."""
    gap = np.zeros((len(d), len(low)))
    for p in range(d.shape[1]):
        gap = np.maximum(gap, np.maximum(d[:, p, None] - high[None, :, p], low[None, :, p] - d[:, p, None]))
    return 1 - gap * gap / 2 + 2e-6


class PivotBlocks:
    """Vectors in blocks, of which only the intervals of their distances to a few pivots are known here.

    A vector belongs to the ring around its nearest pivot in which it lies; a large ring is dealt into blocks by hash. By the
    triangle inequality a query can be no nearer to any vector of a block than its own distance to a pivot lies outside of
    the block's interval. ``rows`` has vec_id, v (length 1) and block.
    """

    def __init__(self, vectors: DataFrame):
        v = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        first = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
        self.pivots = pivots = _matrix(pd.Series([r["v"] for r in first])) if first else np.zeros((0, 1))
        ring = RING

        def place(batches):
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["v"])
                d = _distances(x, pivots)
                home = d.argmin(axis=1)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "v": list(x), "d": list(d), "ring": home * 1000 + (d[np.arange(len(d)), home] / ring).astype(int)})

        placed = write_table(v.mapInPandas(place, "vec_id long, v array<double>, d array<double>, ring long"), "vectors-placed")
        counted = write_table(placed.groupBy("ring").agg(F.count("*").alias("n")), "vector-rings")
        size = max(VECTOR_BLOCK, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_BLOCKS)
        parts = counted.select("ring", F.ceil(F.col("n") / size).alias("parts"))
        block = F.col("ring") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        self.rows = write_table(placed.join(parts, "ring").select("vec_id", "v", "d", block.alias("block")), "vector-blocks")
        drop_table(placed)
        ends = [f(F.get("d", F.lit(p))).alias(f"{f.__name__}{p}") for p in range(len(pivots)) for f in (F.min, F.max)]
        known = self.rows.groupBy("block").agg(F.count("*").alias("n"), *ends).orderBy("block").toPandas()
        self.blocks, self.n = known["block"].to_numpy(), known["n"].to_numpy()
        self.low, self.high = (known[[f"{f}{p}" for p in range(len(pivots))]].to_numpy().astype(float) for f in ("min", "max"))

    def visits(self, queries: DataFrame, k: int, kth: DataFrame | None = None) -> DataFrame:
        """(query_id, q, block): without ``kth`` the most promising blocks that have k vectors besides the query's own; with it
        (query_id, kth) the others that may hold a cosine as high."""
        blocks, n, pivots, low, high, first = self.blocks, self.n, self.pivots, self.low, self.high, kth is None
        rows = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
        rows = rows.withColumn("kth", F.lit(None).cast("double")) if kth is None else rows.join(kth, "query_id")

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.iloc[at : at + 256]
                    if not len(blocks) or not len(part):
                        continue
                    x = _matrix(part["q"])
                    best = highest_cosines(_distances(x, pivots), low, high)
                    order = np.argsort(-best, axis=1, kind="stable")
                    seen = np.cumsum(n[order], axis=1)
                    early = np.zeros(best.shape, bool)
                    np.put_along_axis(early, order, np.hstack([np.zeros((len(part), 1), int), seen[:, :-1]]) <= k, axis=1)
                    i, j = np.nonzero(early if first else ~early & (best >= part["kth"].to_numpy()[:, None]))
                    if len(i):
                        yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[i], "q": [x[a] for a in i], "block": blocks[j]})

        return rows.mapInPandas(run, "query_id long, q array<double>, block long")

    def search(self, visits: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the best k others that a visited block has for a query. A block meets its queries in parts."""
        visits = write_table(visits, "vector-visits")
        parts = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
        # a task gets so many cells at most, on average, however many there are
        cells_all = parts.agg(F.sum("parts")).first()[0] or 0
        tasks = max(1, -(-cells_all // CELLS))
        left = visits.join(parts, "block").select("query_id", "q", "block", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))
        right = self.rows.join(parts, "block").select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

        def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
            y, vid = np.stack(list(held["v"])), held["vec_id"].to_numpy()
            out = []
            for at in range(0, len(asked), QUERY_BLOCK):  # a few more than a block may have the same hash
                some = asked.iloc[at : at + QUERY_BLOCK]
                qid = some["query_id"].to_numpy()
                score = np.round(np.stack(list(some["q"])) @ y.T, 6)
                score[qid[:, None] == vid[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(vid, score.shape), -score), axis=1)[:, :k]
                top = np.take_along_axis(score, best, axis=1)
                ok = np.isfinite(top)
                out.append(pd.DataFrame({"query_id": np.repeat(qid, ok.sum(axis=1)), "vec_id": vid[best][ok], "score": top[ok]}))
            return pd.concat(out)

        left, right = (x.repartition(tasks, "block", "part") for x in (left, right))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, "query_id long, vec_id long, score double")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest by cosine (rounded to 6 digits), without the query's own id; ties to the smaller id.

    A query first meets the blocks that promise most, then only those that may still hold a cosine as high as its kth.
    """
    index = PivotBlocks(vectors)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    first = write_table(ranked(index.search(index.visits(queries, k), k)), "vector-first")
    kth = queries.select(F.col("vec_id").alias("query_id")).distinct().join(first.where(F.col("rank") == k).select("query_id", "score"), "query_id", "left")
    rest = index.search(index.visits(queries, k, kth.select("query_id", F.coalesce("score", F.lit(-2.0)).alias("kth"))), k)
    return ranked(first.drop("rank").unionByName(rest))


def ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def char_similarity(items: DataFrame, concepts: DataFrame, k: int = 20, bonus: float = 0.2) -> DataFrame:
    """(id, concept, score, rank): the higher of the two sequence ratios, plus ``bonus`` if one holds the other, at
    most 1; candidates share a character pair. Labels of one character share that character."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max(ratio(x, y), ratio(y, x)) for x, y in zip(a, b, strict=True)], dtype="float64")

    i = items.select("id", "label", F.explode(grams(F.col("label"), 2)).alias("g"))
    c = concepts.select("concept", F.col("label").alias("c_label"), F.explode(grams(F.col("label"), 2)).alias("g"))
    pairs = i.join(c, "g").select("id", "label", "concept", "c_label").distinct()
    extra = F.when(F.contains("label", "c_label") | F.contains("c_label", "label"), bonus).otherwise(0.0)
    scored = pairs.withColumn("score", F.round(F.least(score("label", "c_label") + extra, F.lit(1.0)), 6))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "concept")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("id", "concept", "score", "rank")


def early_stop(candidates: DataFrame, gate: float = 0.5, limit: int = 3) -> DataFrame:
    """Per id: candidates (concept, similarity, accepted) at or above the gate, ranked by similarity, the first
    ``limit`` of them: the first accepted one (``accepted``), else the most similar (``candidate_review``); no row without one."""
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "concept")
    seen = candidates.where(F.col("similarity") >= gate).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    best = seen.groupBy("id").agg(F.min(F.when(F.col("accepted"), F.struct("rank", "concept", "similarity"))).alias("yes"), F.min(F.struct("rank", "concept", "similarity")).alias("top"))
    pick = F.coalesce("yes", "top")
    return best.select("id", pick["concept"].alias("concept"), pick["similarity"].alias("similarity"), F.when(F.col("yes").isNotNull(), "accepted").otherwise("candidate_review").alias("method"))


#: Names that are looked for in every text as they are.
FEW_NAMES = 64


def mentions(definitions: DataFrame, names: DataFrame, min_length: int = 3) -> DataFrame:
    """(id, name): names of at least ``min_length`` characters that a definition holds, in any case. A name is looked up by
    its rarest gram among the definitions; ``contains`` verifies. A few names go to the definitions, which are then not cut up."""
    n = names.select("name", F.lower("name").alias("low")).where(F.char_length("name") >= min_length).distinct()
    d = definitions.select("id", F.lower("definition").alias("t")).where("t is not null")
    n = write_table(n, "mention-names")
    if n.count() <= FEW_NAMES:
        listed = n.agg(F.collect_list(F.struct("name", "low")).alias("names"))  # one row
        return d.crossJoin(F.broadcast(listed)).select("id", F.explode(F.filter("names", lambda x: F.contains(F.col("t"), x["low"]))["name"]).alias("name")).distinct()
    # the texts stay behind while their grams are looked up, and meet the few names that may be in them once
    rows = d.select("id", F.explode(grams(F.col("t"), min_length)).alias("g"))
    likely = join_dealt(rows, filed(n, "low", rows, min_length), "g", F.col("id")).groupBy("id").agg(F.collect_set(F.struct("name", "low")).alias("names"))
    return d.join(likely, "id").select("id", F.explode(F.filter("names", lambda x: F.contains(F.col("t"), x["low"]))["name"]).alias("name")).distinct()


def token_mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """J10 over whole words, J27: (id, term, start, end) of every word of a text that is a term; places count characters from 0."""
    words = texts.select("id", F.posexplode(F.split("text", r"[^\p{L}\p{N}]")).alias("k", "w"))
    order = Window.partitionBy("id").orderBy("k")
    placed = words.withColumn("start", F.sum(F.char_length("w") + 1).over(order) - F.char_length("w") - 1)
    t = terms.select(F.lower("term").alias("term")).distinct()
    return placed.where("w <> ''").withColumn("term", F.lower("w")).join(t, "term").select("id", "term", F.col("start"), (F.col("start") + F.char_length("term")).alias("end"))


def grouped_mentions(found: DataFrame) -> DataFrame:
    """(id, term, places): the sorted [start, end] of each term."""
    return found.groupBy("id", "term").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("places"))


def _segment(length: Column, k: int, i: int) -> tuple[Column, Column]:
    """Where segment ``i`` of the ``k`` + 1 nearly equal ones of a label of ``length`` begins (from 0), and its length."""
    longer = F.pmod(length, F.lit(k + 1)) - (k + 1 - i)  # the last ones have one character more
    base = F.floor(length / (k + 1)).cast("int")
    return base * i + F.greatest(longer, F.lit(0)), base + (longer >= 0).cast("int")


def segment_keys(label: Column, k: int) -> Column:
    """The segments of an entry, each with ``k``, its number and the entry's length."""
    n = F.char_length(label)
    parts = [(i, *_segment(n, k, i)) for i in range(k + 1)]
    return F.array(*[F.concat_ws(":", F.lit(k), F.lit(i), n, F.substring(label, at + 1, size)) for i, at, size in parts])


def segment_probes(label: Column, k: int) -> Column:
    """The pieces of a label that a segment of an entry within ``k`` edits may be. Of at most k edits some segment has none, and
    for one segment at least the edits before it and those after it are few enough to bound by how far it has moved."""
    n, out = F.char_length(label), []
    for more in range(-k, k + 1):  # so much longer than the entry
        for i in range(k + 1):
            at, size = _segment(n - more, k, i)
            for shift in range(max(-i, more - (k - i)), min(i, more + (k - i)) + 1):
                inside = (n - more >= 0) & (at + shift >= 0) & (at + shift + size <= n)
                out.append(F.when(inside, F.concat_ws(":", F.lit(k), F.lit(i), n - more, F.substring(label, at + shift + 1, size))))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


def fuzzy(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, match, distance): the closest entry within an edit distance of 0, 1 or 2 (lengths to 2, to 5, above);
    ties to the first in order.

    An entry is cut into k + 1 segments for each k, and one of them stands unchanged, hardly moved, in every label within k
    edits: at most 19 pieces of a label, however long, are looked up. No pair is lost; ``levenshtein`` decides.
    """
    limit = F.when(F.char_length("label") <= 2, 0).when(F.char_length("label") <= 5, 1).otherwise(2)
    d = dictionary.select(F.col("label").alias("match")).where("match is not null").distinct()
    entries = d.select("match", F.explode(F.concat(*[segment_keys(F.col("match"), k) for k in (0, 1, 2)])).alias("key"))
    labels = items.select("label").where("label is not null").distinct().withColumn("limit", limit)
    pieces = F.when(F.col("limit") == 0, segment_probes(F.col("label"), 0)).when(F.col("limit") == 1, segment_probes(F.col("label"), 1)).otherwise(segment_probes(F.col("label"), 2))
    pairs = join_dealt(labels.select("label", "limit", F.explode(pieces).alias("key")), entries, "key", F.col("label"))
    near = pairs.withColumn("distance", F.levenshtein("label", "match", 2)).where(F.col("distance").between(0, F.col("limit")))
    best = near.groupBy("label").agg(F.min(F.struct("distance", "match")).alias("m"))
    return items.join(best, "label").groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.match").alias("match"), F.col("m.distance").alias("distance"))


def label_search(rows: DataFrame, key: str, label: str, term: str, share: float = 0.5) -> DataFrame:
    """``rows`` whose label holds ``term``: those whose label is the term where there are any, else the first
    floor(share * n) of all n hits, shorter labels first, then by ``key``. Numbered in ranges, not in one task."""
    from .edges import running_number

    hits = rows.where(F.contains(F.col(label), F.lit(term))).withColumn("__len", F.char_length(label))
    exact = hits.where(F.col(label) == term)
    if not exact.isEmpty():
        return exact.drop("__len")
    most = int(hits.count() * share)
    return running_number(hits, ["__len", key]).where(F.col("n") <= most).drop("__len", "n")


def disambiguate(contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, candidate): the candidate (id, candidate, v) whose vector has the highest cosine with the context (id, v)."""
    c = contexts.select("id", F.col("v").cast("array<double>").alias("q"))
    met = candidates.where("v is not null").select("id", "candidate", F.col("v").cast("array<double>").alias("v")).join(c.where("q is not null"), "id")

    def score(batches):
        for batch in batches:
            if len(batch):
                cosine = np.round((_matrix(batch["v"]) * _matrix(batch["q"])).sum(axis=1), 6)
                yield batch[["id", "candidate"]].assign(score=cosine)

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    s = met.mapInPandas(score, f"id {kinds['id']}, candidate {kinds['candidate']}, score double")
    return s.groupBy("id").agg(F.min(F.struct(-F.col("score"), "candidate")).alias("b")).select("id", F.col("b.candidate").alias("candidate"))


#: A cosine that is NaN, and a missing one, among the scores of J30: as in SQL the one comes before all others, the other after them.
NAN_FIRST, NULL_LAST = 3.0, -3.0


def _firsts(x: np.ndarray, x_ids: np.ndarray, x_there: np.ndarray, y: np.ndarray, y_ids: np.ndarray, y_there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` that has one: its id, the first of the rows of ``y`` with another id, and their score: the highest, of equals the
    smallest id. ``y_ids`` rises."""
    s = x @ y.T
    s[~x_there], s[:, ~y_there] = NULL_LAST, NULL_LAST
    low, high = (np.searchsorted(y_ids, x_ids, side) for side in ("left", "right"))
    for k in np.flatnonzero(low < high):
        s[k, low[k] : high[k]] = -np.inf
    top = s.max(axis=1)
    for k in np.flatnonzero(np.isnan(top)):
        s[k] = np.where(np.isnan(s[k]), NAN_FIRST, s[k])
        top[k] = NAN_FIRST
    # what is rounded to the same number is less than a millionth below the highest
    i, j = np.nonzero(s >= (top - 2e-6)[:, None])
    top = np.round(top, 6)
    same = np.round(s[i, j], 6) == top[i]
    rows, at = np.unique(i[same], return_index=True)
    found = np.isfinite(top[rows])
    return x_ids[rows[found]], y_ids[j[same][at[found]]], top[rows[found]]


def nearest_in_group(contexts: DataFrame, vectors: DataFrame, group: str, missing: bool = False) -> DataFrame:
    """J30 where the candidates of a context (id, v, group) are all other ``vectors`` (candidate, v, group) of its group: (id,
    candidate). With ``missing`` those without a vector take part: null, their cosine, comes after all others, as in SQL.

    They meet in blocks, as matrices; ids are whole numbers. No pair becomes a row, and each block gives one row a context. A
    large block is compared slice by slice, so its pairs never stand in memory together.
    """
    side = lambda df, key, asked: (df if missing else df.where("v is not null")).where(f"{key} is not null").select(F.col(key).cast("long").alias("id"), "v", F.col(group).alias("grp"), F.lit(asked).alias("asked"))
    left, right, n = cells(side(contexts, "id", True), side(vectors, "candidate", False), "grp", (F.col("id"), F.col("id")), (8 * QUERY_BLOCK, 2 * VECTOR_BLOCK))
    key, tasks, step = ["grp", "__i", "__j"], max(1, n), 2 * VECTOR_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(list(batches))
        width = pc.max(pc.list_value_length(met["v"])).as_py() or 0
        asked, held = (some.take(pc.sort_indices(some["id"])) for some in (met.filter(met["asked"]), met.filter(pc.invert(met["asked"]))))
        for b in range(0, len(held), step):  # one slice, unless many have one id
            some = held.slice(b, step)
            y, y_there = _units(some["v"].combine_chunks(), width)
            for a in range(0, len(asked), 256):
                few = asked.slice(a, 256)
                x, x_there = _units(few["v"].combine_chunks(), width)
                yield pa.record_batch(list(map(pa.array, _firsts(x, few["id"].to_numpy(), x_there, y, some["id"].to_numpy(), y_there))), names=["id", "candidate", "score"])

    s = left.unionByName(right).repartition(tasks, *key).groupBy(*key).applyInArrow(run, "id long, candidate long, score double")
    return s.groupBy("id").agg(F.min(F.struct(-F.col("score"), "candidate")).alias("b")).select("id", F.col("b.candidate").alias("candidate"))


def first_description(concepts: DataFrame, statements: DataFrame) -> DataFrame:
    """Concepts with the description of their first statement (smallest URI)."""
    s = statements.groupBy("concept").agg(F.min_by("content", "statement_uri").alias("description"))
    return concepts.join(s, "concept", "left")


def substitute(items: DataFrame, best: DataFrame, order: list[str]) -> DataFrame:
    """(id, label): the normalised name where one is known (the last in order wins), else the label itself."""
    b = best.groupBy("label").agg(F.max_by("normalized", F.struct(*order)).alias("normalized"))
    return items.join(b, "label", "left").select("id", F.coalesce("normalized", "label").alias("label"))


def generic_duplicates(chapters: DataFrame, suffixes) -> DataFrame:
    """Generic chapters with the plain chapter of their base name (the last wins) and how the textbooks compare."""
    base = F.regexp_replace("label", f"({T.alternation(suffixes)})$", "")
    tagged = chapters.withColumn("base", base).withColumn("generic", T.has_suffix(F.col("label"), suffixes))
    plain = tagged.where("not generic").groupBy("label").agg(F.max(F.struct("ord", "id", "textbook_id")).alias("p")).withColumnRenamed("label", "base")
    out = tagged.where("generic").join(plain, "base", "left")
    kind = F.when(F.col("p").isNull(), "none").when(F.col("p.textbook_id") == F.col("textbook_id"), "same_textbook").otherwise("different_textbook")
    return out.select("id", "label", F.col("p.id").alias("plain_id"), kind.alias("kind"))


def match_table(items: DataFrame, exact_hits: DataFrame, picked: DataFrame) -> DataFrame:
    """One row per item: (id, label, concept, method, matched, similarity) from exact hits, else what early_stop picked."""
    e = exact_hits.where("concept is not null").select("id", F.col("concept").alias("e"))
    p = picked.select("id", F.col("concept").alias("p"), "similarity", "method")
    j = items.join(e, "id", "left").join(p, "id", "left")
    method = F.when(F.col("e").isNotNull(), "exact_match").when(F.col("method") == "accepted", "llm_vote").when(F.col("method").isNotNull(), "candidate_review").otherwise("none")
    return j.select("id", "label", F.coalesce("e", "p").alias("concept"), method.alias("method"), (F.col("e").isNotNull() | F.coalesce(F.col("method") == "accepted", F.lit(False))).alias("matched"), F.when(F.col("e").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"))
