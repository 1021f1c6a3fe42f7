"""Counts, profiles and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """Rows per key."""
    return rows.groupBy(*keys).agg(F.count("*").alias(n))


def counts_with_total(rows: DataFrame, key: str) -> DataFrame:
    """A1: rows per key, and a row ``total``."""
    return rows.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col(key)).alias(key), "n")


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """A2, A3: the k keys with most rows; ties by key."""
    return counts(rows, key).orderBy(F.desc("n"), key).limit(k)


def degrees(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """A4: per node out, in and total degree, and how many of the other ends are concepts. concepts (node)."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("o")).union(edges.select("dst", "src", F.lit(0)))
    c = concepts.select(F.col("node").alias("c")).distinct()
    return ends.join(c, ends.other == c.c, "left").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.count("*").alias("degree"), F.count("c").alias("concept_degree"))


def predicate_profile(triples: DataFrame, entity: Column, limit: float = 0.2) -> DataFrame:
    """A5: per predicate rows, share of objects that are entities, and the kind of property."""
    g = triples.groupBy("p").agg(F.count("*").alias("n"), F.avg(entity.cast("double")).alias("r"))
    return g.select("p", "n", F.round("r", 6).alias("entity_ratio"), F.when(F.col("r") >= limit, "object").otherwise("data").alias("kind"))


def sample_objects(triples: DataFrame, entity: Column, k: int = 10) -> DataFrame:
    """Up to k objects per predicate and kind, the smallest by digest, so that any order of rows gives the same."""
    w = Window.partitionBy("p", "kind").orderBy(F.md5(F.col("o").cast("string")), "o")
    return triples.select("p", "o", F.when(entity, "entity").otherwise("value").alias("kind")).distinct().withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= k)


def prefix_counts(paths: DataFrame, sep: str = "/") -> DataFrame:
    """(depth, prefix, n, leaf) over all prefixes of a path column ``path``."""
    parts = F.split("path", sep)
    pre = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), sep).alias("prefix")))).alias("x"))
    return pre.groupBy("x.depth", "x.prefix").agg(F.count("*").alias("n")).withColumn("leaf", F.col("n") == 1)


def distributions(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(attribute, value, n, percent) of several columns; percents are rounded half up to two digits, in whole numbers."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x"))
    g = long.groupBy("x.attribute", "x.value").agg(F.count("*").alias("n"))
    total = g.groupBy("attribute").agg(F.sum("n").alias("all"))
    return g.join(total, "attribute").select("attribute", "value", "n", (F.expr("(20000 * n + all) div (2 * all)") / 100.0).alias("percent"))


def completeness(rows: DataFrame, cols: list[str]) -> DataFrame:
    """One row: all rows, and the nulls of each column."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols])


def match_rate(rows: DataFrame, key: str) -> DataFrame:
    """Per key and over all (``all``) the rows, the matched ones and their share. rows need ``matched``."""
    g = rows.rollup(key).agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.grouping(key).alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col(key)).alias(key), "total", "matched", (F.col("total") - F.col("matched")).alias("new"), F.round(F.col("matched") / F.col("total"), 4).alias("rate"))


def roll_up(rows: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """Per key the sorted distinct values of other columns."""
    return rows.groupBy(key).agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in sets], F.count("*").alias("n"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """(stage, domain, points): distinct points in order of their first place. chunks (pos, stage, domain, point)."""
    first = chunks.groupBy("stage", "domain", "point").agg(F.min("pos").alias("pos"))
    return first.groupBy("stage", "domain").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "point"))), lambda x: x["point"]).alias("points"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row."""
    return counts(rows, key).where("n > 1")


def coverage(edges: DataFrame, types: list[str]) -> DataFrame:
    """Distinct targets of edges of the types over distinct nodes of all edges."""
    ends = edges.select(F.col("src").alias("n")).union(edges.select("dst")).agg(F.count_distinct("n").alias("nodes"))
    t = edges.where(F.col("rel_type").isin(*types)).agg(F.count_distinct("dst").alias("covered"))
    return t.crossJoin(ends).select("covered", "nodes", F.round(F.col("covered") / F.col("nodes"), 6).alias("coverage"))  # one row each


def confidence_shares(rows: DataFrame, band: Column) -> DataFrame:
    """Rows per band with their share."""
    g = rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row per band


def ledger(calls: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per key calls, tokens and cents, and whether the cents pass the limit."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cents").alias("cents")).withColumn("over", F.col("cents") > limit)


def stratified_folds(rows: DataFrame, cls: str, key: str, k: int) -> DataFrame:
    """Rows with ``fold``: dealt in turn within each class, in the order of a digest of the key."""
    from .edges import running_number

    # numbers over all rows in the order of class and digest, less where the class begins: no class has to fit into a task
    n = running_number(rows.withColumn("__digest", F.md5(F.col(key).cast("string"))), [cls, "__digest", key])
    begins = n.groupBy(F.col(cls).alias("__cls")).agg(F.min("n").alias("__begin"))
    j = n.join(begins, n[cls].eqNullSafe(begins["__cls"]))
    return j.withColumn("fold", F.pmod(F.col("n") - F.col("__begin"), F.lit(k)).cast("long")).select(*rows.columns, "fold")


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(fresh, stored_rows, now_rows): whether two tables (uri, label) hold the same rows, each as often, in any order.

    The checksum is the number of rows and two sums of their digests, wide enough not to wrap: other than in an xor, a row
    that is there twice counts twice. A null is told apart from every text, and a null uri from a null label.
    """
    row = [x for c in ("uri", "label") for x in (F.col(c).isNull(), F.col(c))]

    def checksum(df: DataFrame, name: str) -> DataFrame:
        sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(20,0)")).cast("string"), F.lit("0")).alias(f"{name}{seed}") for seed in (1, 2)]
        return df.agg(*sums, F.count("*").alias(f"{name}_rows"))

    both = checksum(stored, "stored").crossJoin(checksum(current, "now"))  # one row each
    same = (F.col("stored1") == F.col("now1")) & (F.col("stored2") == F.col("now2")) & (F.col("stored_rows") == F.col("now_rows"))
    return both.select(same.alias("fresh"), "stored_rows", "now_rows")
