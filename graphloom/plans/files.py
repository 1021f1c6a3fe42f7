"""Queries of the line-oriented sources and of the sinks, over lines and files that Spark makes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..scratch import shared_dir
from ..sources import catalogue, sinks, triples
from . import twins
from .joins import BOOKS_SQL, catalogue_books
from .registry import query
from .twins import TRIPLES_SQL


def _folder(t, name: str) -> str:
    return f"{shared_dir(t._spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def lines_of(rows, *texts):
    """(file, block, seq, text): the given lines of each part, a file per brand, a block per hundred parts."""
    both = rows.select("p_brand", "p_partkey", F.posexplode(F.array(*texts)).alias("pos", "text"))
    return both.select(F.col("p_brand").alias("file"), F.floor(F.col("p_partkey") / 100).alias("block"), (F.col("p_partkey") * len(texts) + F.col("pos")).alias("seq"), "text")


def _uri(kind: str, key):
    return F.concat(F.lit(f"<http://kg.example/instance/{kind}#"), key.cast("string"), F.lit(">"))


@query("s3_linked_objects", "select 'partOf' as relation, 'http://kg.example/instance/part#' || p_partkey::varchar as subject, 'http://kg.example/instance/class#' || p_size::varchar as object from part union all select 'belongsTo', 'http://kg.example/instance/part#' || p_partkey::varchar, 'http://kg.example/instance/type#' || p_size::varchar from part")
def s3(t):
    p = t.part
    subject = F.concat(_uri("part", F.col("p_partkey")), F.lit(' rdfs:label "x" ;'))
    text = lines_of(p, subject, F.concat(F.lit("  k:partOf "), _uri("class", F.col("p_size")), F.lit(" ;")), F.concat(F.lit("  k:belongsTo "), _uri("type", F.col("p_size")), F.lit(" .")))
    return triples.linked_objects(text)


def _labels(t):
    line = F.concat(_uri("part", F.col("p_partkey")), F.lit(" rdf:type <http://kg.example/"), F.col("p_type"), F.lit('> ; rdfs:label "'), F.col("p_name"), F.when(F.col("p_size") > 25, F.lit('"@en .')).otherwise(F.lit('" .')))
    return lines_of(t.part, F.lit("@prefix k: <http://kg.example/> ."), line)


@query("s4_typed_labels", "select 'http://kg.example/instance/part#' || p_partkey::varchar as subject, 'type' as kind, 'http://kg.example/' || p_type as value, null as language from part union all select 'http://kg.example/instance/part#' || p_partkey::varchar, 'label', p_name, case when p_size > 25 then 'en' else 'zh' end from part")
def s4(t):
    return triples.typed_labels(_labels(t))


@query("s5_turtle_statistics", "select p_brand as file, count(*) as prefixes, 0::bigint as statements, count(*) as instances, count(*) as labels, count(*) as types, count(distinct p_partkey) as subjects from part group by 1")
def s5(t):
    return triples.turtle_statistics(_labels(t))


@query("s1_discovered_catalogues", f"with {BOOKS_SQL} select book as textbook_id, count(distinct chapter) as chapters, count(section) as sections from books left join ch using (book) left join se using (chapter) group by 1")
def s1(t):
    books, root = catalogue_books(t), _folder(t, "catalogues")
    places = {"primary": "primary/grade1/shang.json", "middle": "middle/grade7/xia.json", "high": "high/bixiu1/textbook.json"}
    for stage, place in places.items():  # the layouts; each has its books in one folder, a file a book
        books.where(F.col("stage") == stage).write.option("maxRecordsPerFile", 1).json(f"{root}/{place}")
    books.write.json(f"{root}/primary/notes.json")  # no layout has this
    tables = catalogue.flatten(catalogue.read_catalogues(t._spark, catalogue.discover(t._spark, root)))
    per = lambda df, name: df.groupBy("textbook_id").agg(F.count("*").alias(name))
    out = tables["textbooks"].select("textbook_id").join(per(tables["chapters"], "chapters"), "textbook_id", "left").join(per(tables["sections"], "sections"), "textbook_id", "left")
    return out.select("textbook_id", F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("sections", F.lit(0)).alias("sections"))


@query("s6_repaired_tsv", "select 'http://kg.example/' || p_partkey::varchar as s, 'http://kg.example/p' as p, p_name || chr(10) || 'more' || chr(9) || p_type as o from part")
def s6(t):
    first = F.concat(F.lit("http://kg.example/"), F.col("p_partkey").cast("string"), F.lit("\thttp://kg.example/p\t"), F.col("p_name"))
    return triples.repaired_tsv(lines_of(t.part, first, F.concat(F.lit("more\t"), F.col("p_type"))))


@query("s12_exam_texts", "select conv_id::varchar as id, md5(string_agg(role || chr(10) || text || chr(10) || case when role = 'user' then 'first' else 'a' || chr(10) || role end, chr(10) order by turn, text)) as digest from conversations group by 1")
def s12(t):
    # what users say are open questions with two answers, the rest has choices
    user = F.col("role") == "user"
    q = F.struct(F.when(user, "open").otherwise("choice").alias("type"), F.col("role").alias("passage"), F.col("text").alias("question"), F.when(~user, F.array(F.lit("a"), "role")).alias("choices"), F.array(F.lit("first"), F.lit("second")).alias("answers"))
    exams = t.conversations.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text", q.alias("q")))), lambda x: x["q"]).alias("Questions"))
    return catalogue.exam_texts(exams).select("id", F.md5("text").alias("digest"))


@query("s14_written_tables", "select 'concepts' as name, count(*) as n from part union all select 'related', count(*) from (select distinct l_suppkey, l_partkey from lineitem)")
def s14(t):
    counts = sinks.write_tables({"concepts": twins.concepts(t), "related": twins.related(t)}, _folder(t, "tables"))
    return t._spark.createDataFrame(list(counts.items()), "name string, n bigint")


@query("s15_s16_turtle", """select '<urn:kg#' || p_partkey::varchar || '> rdfs:label "' || p_name || '" ; kg:source "{\\"textbook_id\\":\\"' || p_brand || '\\",\\"section_id\\":\\"' || p_type || '\\"}" .' as value from part""")
def s15(t):
    return sinks.turtle_points(t.part.select(F.col("p_partkey").cast("string").alias("uri"), F.col("p_name").alias("label"), F.col("p_brand").alias("textbook_id"), F.col("p_type").alias("section_id")), "urn:kg")


@query("s17_s18_split_by_subject", TRIPLES_SQL + r" select coalesce(nullif(regexp_extract(s, 'instance/([^/#]+)[/#]', 1), ''), 'unknown') as subject, count(*) as rows from triples group by 1")
def s17(t):
    return triples.split_by_subject(twins.triples(t), _folder(t, "split"))
