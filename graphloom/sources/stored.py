"""Stored tables that changes are merged into (S19, S20, S22, T1): Parquet in buckets by the hash of the key, of which a change
rewrites those alone in which something changes. Each bucket is one folder and written whole, so small files do not gather."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import update_many, upsert_edges, upsert_nodes

PENDING, LAYOUT = "_pending", "_layout"  # folders that readers of the table do not see


class StoredTable:
    """A table under ``path``. A change is first written beside the table, then moved into its buckets; if that is broken off,
    the next one to open or change the table ends it, so a change is made once however often it is tried."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/{LAYOUT}").first()
        self.keys, self.buckets = list(row["keys"]), row["buckets"]
        self.finish()

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> StoredTable:
        """Writes ``rows``, one for each key, as a new table."""
        spark = rows.sparkSession
        spark.createDataFrame([(keys, buckets)], "keys array<string>, buckets int").coalesce(1).write.parquet(f"{path.rstrip('/')}/{LAYOUT}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(path)
        return cls(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _raw(self) -> DataFrame | None:
        if not any(s.getPath().getName().startswith("bucket=") for s in self._fs().listStatus(self._at(self.path))):
            return None
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def read(self) -> DataFrame | None:
        """The rows of the table; None while it has had none yet."""
        raw = self._raw()
        return raw if raw is None else raw.drop("bucket")

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def finish(self) -> None:
        """Moves a change that is wholly written into the table, and drops one that is not."""
        pending, fs = f"{self.path}/{PENDING}", self._fs()
        if fs.exists(self._at(f"{pending}/_SUCCESS")):
            rows = self.spark.read.parquet(pending).repartition("bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        if fs.exists(self._at(pending)):
            fs.delete(self._at(pending), True)

    def change(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts ``combine`` of the rows there are and ``new`` in the place of the former, for the buckets that ``new`` has keys of,
        and returns those that this changed. ``combine`` may add rows and change them, but takes none away."""
        self.finish()
        new = self._bucketed(new)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return []
        there = self._raw()
        old = new.limit(0) if there is None else there.where(F.col("bucket").isin(touched))
        after = self._bucketed(combine(old.drop("bucket"), new.drop("bucket")))
        changed = self._changed(old, after)
        if changed:
            after.where(F.col("bucket").isin(changed)).repartition("bucket").write.mode("overwrite").parquet(f"{self.path}/{PENDING}")
            self.finish()
        return changed

    def _changed(self, old: DataFrame, after: DataFrame) -> list[int]:
        """Buckets that do not hold the same rows, by counts and wide sums of digests; a column that is new changes all."""
        more = set(after.columns) - set(old.columns)
        row = [x for c in sorted(after.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        same = lambda df, name: df.groupBy("bucket").agg(F.struct(F.count("*"), *[F.sum(F.xxhash64(F.lit(s), *row).cast("decimal(20,0)")) for s in (1, 2)]).alias(name))
        a = same(after, "a")
        b = a.select("bucket", F.col("a").alias("b")).limit(0) if more else same(old.select(*after.columns), "b")
        return sorted(r[0] for r in a.join(b, "bucket", "left").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())

    def merge(self, new: DataFrame, clear: list[str] = ()) -> list[int]:
        """Upsert; a null keeps the old value, but in the columns of ``clear``."""
        return self.change(new, lambda old, rows: upsert_nodes(old, rows, self.keys, list(clear)))

    def merge_edges(self, new: DataFrame, nodes: DataFrame, clear: list[str] = ()) -> list[int]:
        """Upsert of edges (src, rel_type, dst) both of whose ends are in ``nodes.uri``."""
        return self.change(new, lambda old, rows: upsert_edges(old, rows, nodes, list(clear)))

    def update(self, changes: DataFrame, clear: list[str] = ()) -> list[int]:
        """Changes to rows that exist, by a key of one column; others are ignored."""
        return self.change(changes, lambda old, rows: update_many(old, rows, self.keys[0], list(clear)))

    def merge_last(self, new: DataFrame, order: str) -> list[int]:
        """Per key the row with the greatest ``order``, of those there are and the new ones; ties to the greatest row."""

        def last(old: DataFrame, rows: DataFrame) -> DataFrame:
            cols = [c for c in rows.columns if c not in self.keys and c != order]
            both = old.select(*rows.columns).unionByName(rows)
            return both.groupBy(*self.keys).agg(F.max(F.struct(order, *cols)).alias("x")).select(*[c if c in self.keys else F.col(f"x.{c}").alias(c) for c in rows.columns])

        return self.change(new, last)
