"""How the given tables stand for the parts of a knowledge graph, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import dealt

STATUS = {"purchase": "mastered", "click": "in_progress", "view": "in_progress"}
STATUS_SQL = "case event_type when 'purchase' then 'mastered' when 'click' then 'in_progress' when 'view' then 'in_progress' else 'not_started' end"


def concepts(t) -> DataFrame:
    """uri, label, cls: parts."""
    return t.part.select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("label"), F.col("p_type").alias("cls"))


def heap(t) -> DataFrame:
    """A hierarchy: part k hangs below part (k - 1) div 2."""
    return t.part.where("p_partkey > 0").select(F.floor((F.col("p_partkey") - 1) / 2).alias("src"), F.col("p_partkey").alias("dst"))


def related(t) -> DataFrame:
    """Related-to edges: distinct supplier-part pairs."""
    return dealt(t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), "src", "dst").distinct()


def progress(t) -> DataFrame:
    """user, entity, status, score, ts, event_id: events; the entity is the number in props."""
    kind = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return t.events.select(
        F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("entity"), F.col("event_type").alias("subject"),
        F.coalesce(kind[F.col("event_type")], F.lit("not_started")).alias("status"), F.floor(F.col("value")).cast("long").alias("score"), "ts", "event_id",
    )


def decisions(t) -> DataFrame:
    """Two recorded decisions per document."""
    c = lambda k: F.pmod(F.col("doc_id") + k, F.lit(11)) / 10.0
    return t.labels.where("doc_id is not null").select("doc_id", (F.col("quality") == 1).alias("d1"), c(0).alias("c1"), (F.col("toxic") == 0).alias("d2"), c(3).alias("c2"))


def triples(t) -> DataFrame:
    """s, p, o of documents' attributes and their links to sources."""
    d = t.documents
    s = F.concat(F.lit("http://kg.example/"), F.when(F.col("doc_id") % 3 == 0, "statement").otherwise("instance"), F.lit("/"), F.col("lang"), F.lit("#"), F.col("doc_id").cast("string"))
    one = lambda p, o: d.select(s.alias("s"), F.lit(f"http://kg.example/p/{p}").alias("p"), o.cast("string").alias("o"))
    return one("source", F.concat(F.lit("http://kg.example/source/"), F.col("source"))).union(one("chars", F.col("n_chars"))).union(one("lang", F.col("lang")))


TRIPLES_SQL = """with base as (select 'http://kg.example/' || case when doc_id % 3 = 0 then 'statement' else 'instance' end || '/' || lang || '#' || doc_id::varchar as s, source, n_chars, lang from documents),
triples as (select s, 'http://kg.example/p/source' as p, 'http://kg.example/source/' || source as o from base union all select s, 'http://kg.example/p/chars', n_chars::varchar from base union all select s, 'http://kg.example/p/lang', lang from base)"""
PROGRESS_SQL = f"""with progress as (select user_id as "user", (props::json->>'k')::bigint as entity, event_type as subject, {STATUS_SQL} as status, floor(value)::bigint as score, ts, event_id from events),
latest as (select "user", entity, status, score, ts from (select *, row_number() over (partition by "user", entity order by ts desc, event_id desc) as rn from progress) where rn = 1)"""
HEAP_SQL = "with heap as (select (p_partkey - 1) // 2 as src, p_partkey as dst from part where p_partkey > 0)"
DECISIONS_SQL = "with pairs as (select doc_id, quality = 1 as d1, (doc_id % 11)::double / 10 as c1, toxic = 0 as d2, ((doc_id + 3) % 11)::double / 10 as c2 from labels)"
