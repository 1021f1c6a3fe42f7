"""Nested catalogues: discovery, flattening, and readers that accept two shapes of one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


# Where a folder of catalogues has its books
LAYOUTS = ["primary/grade*/shang.json", "primary/grade*/xia.json", "middle/grade*/shang.json", "middle/grade*/xia.json", "high/bixiu*/textbook.json"]


def discover(spark: SparkSession, root: str) -> list[str]:
    """Those of the layouts under ``root`` that have a book, as globs for ``read_catalogues``."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    globs = [f"{root}/{x}" for x in LAYOUTS]
    return [g for g in globs if len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(g)) or ())]


def read_catalogues(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """One row per book, with the file it came from."""
    return spark.read.schema(schemas.CATALOGUE).option("multiLine", True).json(glob).withColumn("file", F.input_file_name())


def flatten(books: DataFrame, prefix: str = "urn:kg/instance/math") -> dict[str, DataFrame]:
    """Tables textbooks, chapters, sections, points, contains and in_unit. Positions become explicit ordinals."""
    tb = books.withColumn("textbook_id", T.textbook_id(F.col("publisher"), F.col("grade"), F.col("semester")))
    ch = tb.select("textbook_id", "stage", "grade", F.posexplode_outer("chapters").alias("chapter_pos", "c")).where("c is not null").withColumn("chapter_id", T.child_id(F.col("textbook_id"), F.col("c.chapter_order")))
    se = ch.select("textbook_id", "stage", "grade", "chapter_id", "chapter_pos", F.posexplode_outer("c.sections").alias("section_pos", "s")).where("s is not null").withColumn("section_id", T.child_id(F.col("chapter_id"), F.col("s.section_order")))
    kp = se.select("textbook_id", "stage", "grade", "chapter_pos", "section_id", "section_pos", F.posexplode("s.knowledge_points").alias("point_pos", "label")).where("label is not null and trim(label) <> ''")
    edge = lambda df, a, at, b, bt: df.select(F.col(a).alias("from_id"), F.lit(at).alias("from_type"), F.col(b).alias("to_id"), F.lit(bt).alias("to_type"), F.lit("CONTAINS").alias("relation_type"))
    return {
        "textbooks": tb.select("textbook_id", "subject", "stage", "grade", "semester", "publisher", "edition"),
        "chapters": ch.select("chapter_id", F.col("c.chapter_name").alias("label"), F.col("c.chapter_order").alias("ord"), "textbook_id"),
        "sections": se.select("section_id", F.col("s.section_name").alias("label"), F.col("s.section_order").alias("ord"), "chapter_id", "textbook_id"),
        "points": kp,
        "contains": edge(ch, "textbook_id", "Textbook", "chapter_id", "Chapter").unionByName(edge(se, "chapter_id", "Chapter", "section_id", "Section")),
        "in_unit": kp.select("label", "section_id", "textbook_id"),
    }


def either_shape(content: Column, element: str, key: str) -> Column:
    """The elements of a JSON text that is a bare list or an object holding the list under ``key``."""
    wrapped = F.from_json(content, f"struct<{key}:array<{element}>>")[key]
    return F.coalesce(wrapped, F.from_json(content, f"array<{element}>"), F.from_json(F.lit("[]"), f"array<{element}>"))


def exam_texts(exams: DataFrame) -> DataFrame:
    """One text per exam: passage, question and choices; for open questions the first answer."""
    q = exams.select("id", F.posexplode_outer("Questions").alias("pos", "q"))
    body = F.when(F.col("q.type") == "open", F.concat_ws("\n", "q.passage", "q.question", F.get(F.col("q.answers"), 0))).otherwise(F.concat_ws("\n", "q.passage", "q.question", F.array_join("q.choices", "\n")))
    rows = q.select("id", F.struct("pos", body.alias("txt")).alias("x"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["txt"]), "\n").alias("text"))
