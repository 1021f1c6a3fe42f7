"""Turtle and TSV triples read as lines (S3-S7, S13, S17, S18, L20). A line table has (file, block, seq, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.skew import dealt


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text) of text files. Large files are read in blocks by many tasks: ``block`` is where a block starts,
    ``seq`` grows with the lines inside it, so (block, seq) is the order of a file's lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` with the last value that is not null on a line or before it in its file. Windows run within blocks; what a
    block begins with comes from the last values of the blocks before it, a row each, that stands before its lines. Lines are
    sorted for that, so they are dealt by their number."""
    n, rows = lines.count(), lines.withColumn("__v", value).withColumn("__line", F.lit(True))
    at = dealt(rows.select("file", "block", "seq", "__v"), "file", "block", n=n)
    blocks = at.groupBy("file", "block").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("seq"))).alias("__last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("file", "block", F.last("__last", ignorenulls=True).over(before).alias("__v"), F.lit(False).alias("__line"))
    both = dealt(rows.unionByName(begins.where("__v is not null"), allowMissingColumns=True), "file", "block", n=n)
    inside = Window.partitionBy("file", "block").orderBy("__line", "seq")
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(inside)).where("__line").drop("__v", "__line")


def linked_objects(lines: DataFrame, predicates=("partOf", "belongsTo")) -> DataFrame:
    """S3: (relation, subject, object): the current subject is carried forward to the objects of the predicates."""
    start = F.regexp_extract("text", r"^<([^>]+)>", 1)
    tagged = carried(lines, F.when(start != "", start), "subject")

    def found(p: str) -> Column:
        objects = F.regexp_extract_all(F.regexp_extract("text", rf"{p}>?\s+(.*)$", 1), F.lit("<([^>]+)>"), 1)
        return F.transform(objects, lambda o: F.struct(F.lit(p).alias("relation"), o.alias("object")))

    pairs = F.explode(F.flatten(F.array(*[found(p) for p in predicates])))
    return tagged.where("subject is not null").select("subject", pairs.alias("x")).select("x.relation", "subject", "x.object")


def typed_labels(lines: DataFrame, *keep: str) -> DataFrame:
    """(subject, kind, value, language) of types and labels, with the columns of ``lines`` to ``keep``; a label without
    a tag is in ``zh``."""
    subject = F.regexp_extract("text", r"^<([^>]+)>", 1)
    types = lines.select(*keep, subject.alias("subject"), F.lit("type").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"(?:rdf:type|\sa)\s+<([^>]+)>"), 1)).alias("value"), F.lit(None).cast("string").alias("language"))
    label = lines.select(*keep, subject.alias("subject"), F.explode(F.regexp_extract_all("text", F.lit(r'label\s+("[^"]*"(?:@[a-z]+)?)'), 1)).alias("x"))
    tag = F.regexp_extract("x", "@([a-z]+)$", 1)
    labels = label.select(*keep, "subject", F.lit("label").alias("kind"), F.regexp_extract("x", '^"([^"]*)"', 1).alias("value"), F.when(tag == "", "zh").otherwise(tag).alias("language"))
    return types.unionByName(labels).where("subject <> ''")


def turtle_statistics(lines: DataFrame) -> DataFrame:
    """Per file: prefixes, labels, types, distinct subjects, statements and instances."""
    facts = typed_labels(lines, "file")
    per = lines.groupBy("file").agg(F.count_if(F.startswith("text", F.lit("@prefix"))).alias("prefixes"), F.count_if(F.contains("text", F.lit("/statement/"))).alias("statements"), F.count_if(F.contains("text", F.lit("/instance/"))).alias("instances"))
    of = facts.groupBy("file").agg(F.count_if(F.col("kind") == "label").alias("labels"), F.count_if(F.col("kind") == "type").alias("types"), F.count_distinct("subject").alias("subjects"))
    return per.join(of, "file", "left").select("file", "prefixes", "statements", "instances", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("labels", "types", "subjects")])


def repaired_tsv(lines: DataFrame) -> DataFrame:
    """(s, p, o); a record starts where a line has three fields and its second starts with http, and takes the lines
    after it up to the next start, their tabs and line ends being part of the object."""
    f = F.split("text", "\t")
    start = (F.size(f) >= 3) & F.startswith(F.get(f, 1), F.lit("http"))
    tagged = carried(lines, F.when(start, F.struct("block", "seq")), "rec").where("rec is not null")
    whole = tagged.groupBy("file", "rec").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "\n").alias("t"))
    cut = F.split("t", "\t", 3)
    return whole.select(F.get(cut, 0).alias("s"), F.get(cut, 1).alias("p"), F.get(cut, 2).alias("o"))


def valid_triples(triples: DataFrame) -> DataFrame:
    """One row: whether every subject and predicate is a URI and every object is there (true for no rows)."""
    good = F.startswith("s", F.lit("http")) & F.startswith("p", F.lit("http")) & F.col("o").isNotNull()
    return triples.agg(F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(True)).alias("ok"))


def quarantine(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) triples by the rule of S7."""
    good = F.coalesce(F.startswith("s", F.lit("http")) & F.startswith("p", F.lit("http")) & F.col("o").isNotNull(), F.lit(False))
    return triples.where(good), triples.where(~good)


def predicate_slice(triples: DataFrame, predicate: str) -> DataFrame:
    """The triples of one predicate; a table partitioned by ``p`` is pruned to one folder."""
    return triples.where(F.col("p") == predicate)


def split_by_subject(triples: DataFrame, path: str, skip_unknown: bool = False) -> DataFrame:
    """Writes one folder per subject code and returns (subject, rows) as written, for the conservation check."""
    out = triples.withColumn("subject", T.subject_of_uri(F.col("s")))
    if skip_unknown:
        out = out.where("subject <> 'unknown'")
    out.write.mode("overwrite").partitionBy("subject").parquet(path)
    spark = triples.sparkSession
    return spark.read.parquet(path).groupBy("subject").agg(F.count("*").alias("rows"))
