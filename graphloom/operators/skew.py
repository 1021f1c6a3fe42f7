"""Joins in which one key or group may hold a large share of all rows: its rows are dealt out, the others meet as usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table

#: Rows of one key that may meet in one task.
KEY_ROWS = 100_000
#: Rows of a task on average, where their number says how many tasks there are.
TASK_ROWS = 250_000
#: Rows of one group whose pairs may be made in one task.
PAIR_ROWS = 2048


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``rows``, about ``n`` if stated, dealt by the keys into as many tasks as their number asks for, so that what a task holds
    does not grow with it."""
    n = rows.count() if n is None else n
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def parts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, parts) of the keys with more than ``size`` rows, usually few or none, so that Spark broadcasts them by their
    size; where they are many, it deals them by the key and splits what is skewed."""
    n = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n")).where(F.col("n") > size)
    return write_table(n.select("__key", F.ceil(F.col("n") / size).cast("int").alias("__parts")), "hot-keys")


def join_dealt(many: DataFrame, few: DataFrame, key: str, by: Column, size: int | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``key``: the rows of ``many`` under a key that has more than ``size`` are dealt into parts
    by the hash of ``by``, and those of ``few`` under it go to each part."""
    hot = parts(many, key, size or KEY_ROWS)
    if hot.isEmpty():
        return many.join(few, key)
    n = F.coalesce("__parts", F.lit(1))
    mark = lambda df, part: df.join(hot, F.col(key) == F.col("__key"), "left").select(*df.columns, part.alias("__part"))
    a, b = mark(many, F.pmod(F.xxhash64(by), n).cast("int")), mark(few, F.explode(F.sequence(F.lit(0), n - 1)))
    return a.join(b, [key, "__part"]).drop("__part")


def pairs_within(rows: DataFrame, group: str, value: Column, size: int | None = None) -> DataFrame:
    """(grp, lo, hi): every two different values of a group, once, the lower one first; nulls have none.

    A group of more than ``size`` rows is dealt into parts by the hash of the value, and the pairs of parts (i, j), i <= j,
    are its tasks: a value goes on the left to all j from its own part on, on the right to all i up to it.
    """
    m = rows.select(F.col(group).alias("grp"), value.alias("x")).where("grp is not null and x is not null").distinct()
    hot = parts(rows, group, size or PAIR_ROWS)
    if hot.isEmpty():
        return m.withColumnRenamed("x", "lo").join(m.withColumnRenamed("x", "hi"), "grp").where("lo < hi")
    p = F.coalesce("__parts", F.lit(1))
    m = m.join(hot, F.col("grp") == F.col("__key"), "left").select("grp", "x", p.alias("p"), F.pmod(F.xxhash64("x"), p).cast("int").alias("q"))
    left = m.select("grp", F.col("x").alias("a"), F.col("q").alias("i"), F.explode(F.sequence("q", F.col("p") - 1)).alias("j"))
    right = m.select("grp", F.col("x").alias("b"), F.col("q").alias("j"), F.explode(F.sequence(F.lit(0), "q")).alias("i"))
    met = left.join(right, ["grp", "i", "j"]).where("i < j or a < b")
    return met.select("grp", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def cells(left: DataFrame, right: DataFrame, key: str, by: tuple[Column, Column], sizes: tuple[int, int]) -> tuple[DataFrame, DataFrame, int]:
    """``left`` and ``right`` for a join on (``key``, __i, __j) in which every two rows of one key meet once, and the number of these
    cells. A key's rows are dealt into parts of about ``sizes`` rows by the hashes of ``by``, and each two parts are a cell."""
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(name))
    parts_of = lambda c, size: F.ceil(F.col(c) / size).cast("int").alias(c)
    n = write_table(count(left, "__m").join(count(right, "__n"), "__key").select("__key", parts_of("__m", sizes[0]), parts_of("__n", sizes[1])), "cells")
    total = n.agg(F.sum(F.col("__m").cast("long") * F.col("__n"))).first()[0] or 0
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda at, c: F.pmod(F.xxhash64(by[at]), F.col(c)).cast("int")
    a = left.join(n, F.col(key) == F.col("__key")).select(*left.columns, own(0, "__m").alias("__i"), each("__n").alias("__j"))
    b = right.join(n, F.col(key) == F.col("__key")).select(*right.columns, each("__m").alias("__i"), own(1, "__n").alias("__j"))
    return a, b, total
