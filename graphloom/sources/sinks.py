"""Sinks and idempotent changes of node and edge tables (S8, S9, S14-S16, S19-S24). Changes give a new table, to be written to a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of the first row of a key in the stated order."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of the last row of a key in the stated order."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes each table as Parquet and returns its row count, observed while it is written."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def turtle_points(points: DataFrame, prefix: str) -> DataFrame:
    """One Turtle statement per point, in a column ``value`` for ``write.text``, with its provenance as JSON."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    mark = F.to_json(F.struct("textbook_id", "section_id"))
    return points.select(F.concat(F.lit(f"<{prefix}#"), F.col("uri"), F.lit("> rdfs:label "), q(F.col("label")), F.lit(" ; kg:source "), q(mark), F.lit(" .")).alias("value"))


def new_only(report: DataFrame) -> DataFrame:
    """The rows of a comparison report that are new."""
    return report.where("status = 'new'")


def _merged(old: DataFrame, new: DataFrame, keys: list[str], clear: list[str]) -> list[Column]:
    cols = list(dict.fromkeys([*old.columns, *new.columns]))
    out = []
    for c in cols:
        if c in keys:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns or c in clear:
            out.append(F.when(F.col(f"n.{keys[0]}").isNotNull() | F.lit(c not in old.columns), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}") if c in old.columns else F.lit(None)).alias(c))
        else:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
    return out


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str], clear: list[str] = ()) -> DataFrame:
    """Rows of ``new`` update or add to ``old``; a null keeps the old value, but in the columns of ``clear``."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.alias("o").join(new.alias("n"), on, "full_outer").select(*_merged(old, new, list(keys), list(clear)))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, clear: list[str] = ()) -> DataFrame:
    """As S19 on (src, rel_type, dst); new edges need both their ends in ``nodes.uri``."""
    ends = nodes.select("uri").distinct()
    ok = new.join(ends, new.src == ends.uri, "left_semi").join(ends, new.dst == ends.uri, "left_semi")
    return upsert_nodes(old, ok, ["src", "rel_type", "dst"], clear)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; missing columns become null."""
    return old.unionByName(new, allowMissingColumns=True)


def update_many(old: DataFrame, changes: DataFrame, key: str, clear: list[str] = ()) -> DataFrame:
    """Changes to rows that exist; others are ignored."""
    joined = old.alias("o").join(changes.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.select(*[c for c in _merged(old, changes, [key], list(clear))]).select(*old.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone.uri``, and edges without those that touch them."""
    g = gone.select(F.col("uri").alias("gone_uri")).distinct()
    return nodes.join(g, nodes.uri == g.gone_uri, "left_anti"), edges.join(g, edges.src == g.gone_uri, "left_anti").join(g, edges.dst == g.gone_uri, "left_anti")


def replace_type(edges: DataFrame, new: DataFrame, rel_type: str) -> DataFrame:
    """All edges of one type are replaced by ``new``."""
    return edges.where(F.col("rel_type") != rel_type).unionByName(new.withColumn("rel_type", F.lit(rel_type)), allowMissingColumns=True)


def overwrite_type(new: DataFrame, path: str) -> None:
    """S24 on disk: only the partitions of the types in ``new`` are overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rel_type").parquet(path)
