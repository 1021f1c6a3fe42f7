"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write_table

#: A key with more than one in so many of the rows counted is hot; there are fewer of them than this.
HOT_ONE_IN = 10_000
HOT_LEAST = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key (as a long) and the text, so that other columns, whatever their names, are never read."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def several_texts(rows: DataFrame) -> DataFrame:
    """__several: the doc_ids of ``rows`` (doc_id, text) that stand at different texts; usually none, so that Spark broadcasts it."""
    token = F.xxhash64("text")
    found = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(token).alias("lo"), F.max(token).alias("hi")).where("lo <> hi")
    return write_table(found.select(F.col("doc_id").alias("__several")), "several-texts")


def with_version(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with ``v``: 0, or where a doc_id stands at different texts the hash of the text. The key of a
    document is (doc_id, v): rows that repeat both id and text are one document given twice."""
    several = several_texts(rows)
    v = F.when(F.col("__several").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return rows.join(several, F.col("doc_id") == F.col("__several"), "left").select("doc_id", "text", v.cast("long").alias("v"))


def join_by_count(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``counted``, a written table with one row a key and ``n``, the rows of that key.

    Keys with more than one in HOT_ONE_IN of all rows, fewer than HOT_ONE_IN keys, are broadcast and their rows stay where
    they are; the others meet by a shuffle, in which no key is hot. Only the hashes of the hot keys reach the driver.
    """
    if [rows.schema[k].dataType for k in keys] != [counted.schema[k].dataType for k in keys]:
        raise TypeError(f"the keys {keys} differ in type")  # their hashes would too
    total = counted.agg(F.sum("n")).first()[0] or 0
    token = F.xxhash64(*keys)
    hot = [r[0] for r in counted.where(F.col("n") > max(HOT_LEAST, total // HOT_ONE_IN)).select(token).distinct().collect()]
    if not hot:
        return rows.join(counted, keys)
    # keys that share a hash are on the same side, whichever that is
    cold = rows.where(~token.isin(hot)).join(counted.where(~token.isin(hot)), keys)
    return rows.where(token.isin(hot)).join(F.broadcast(counted.where(token.isin(hot))), keys).select(*cold.columns).unionByName(cold)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict] | dict | None], schema: str) -> DataFrame:
    """``fn`` turns a batch of rows into columns by name (or several such batches)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            for cols in [out] if isinstance(out, dict) else out or ():
                yield pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices of few rows, to bound what Python objects hold at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class WordHashes(dict):
    """word -> 64-bit hash, as a numpy integer; emptied when it has grown past ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


P = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` words; fewer words give one hash of them all, none give none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * P + words[k : len(words) - n + 1 + k]
    return mixed(h)
