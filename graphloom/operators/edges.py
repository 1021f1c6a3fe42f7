"""Edge building, resolution and lookups over node, edge and triple tables (J11-J20, J22-J25, J31-J40, J42, J43, W*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import PAIR_ROWS, cells, pairs_within, parts

#: Users of a node that go along its edges in one row.
USERS = 256


def teaches_before(points: DataFrame) -> DataFrame:
    """(src, dst): points of an earlier section of a chapter before those of a later one, distinct. points (chapter, pos, point)."""
    met = pairs_within(points, "chapter", F.struct("pos", "point")).where("lo.pos < hi.pos and lo.point <> hi.point")
    return met.select(F.col("lo.point").alias("src"), F.col("hi.point").alias("dst")).distinct()


def neighbour_pairs(concepts: DataFrame, reach: int = 5, parts: int | None = None) -> DataFrame:
    """(a, b, gap): each concept with the next ``reach`` ones in (label, uri) order, so that each pair stands once.

    Ranks are made in two passes, counts per range of labels and then ranks within it, so no task holds all concepts.
    """
    ranked = running_number(concepts, ["label", "uri"], parts)
    a = ranked.select(F.col("uri").alias("a"), F.col("n").alias("na"), F.floor(F.col("n") / reach).alias("home"))
    b = ranked.select(F.col("uri").alias("b"), F.col("n").alias("nb"), F.floor(F.col("n") / reach).alias("cell"))
    # a concept's next ones lie in its own cell or the one after
    j = a.select("a", "na", F.explode(F.array(F.col("home"), F.col("home") + 1)).alias("cell")).join(b, "cell")
    return j.where((F.col("nb") - F.col("na")).between(1, reach)).select("a", "b", (F.col("nb") - F.col("na")).alias("gap"))


#: Rows in a range of ``running_number``.
RANGE_ROWS = 500_000


def running_number(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``n``, 1, 2, ... in the stated order over all rows.

    Rows are dealt out by ranges of the order, as many as the number of rows asks for (RANGE_ROWS each) unless stated;
    numbers run within a range, on top of the counts of the ranges before it.
    """
    if parts is None:
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    spread = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    from ..scratch import write_table

    held = write_table(spread, "ranges")  # the ranges must stay as they are for both passes
    sizes = held.groupBy("__part").agg(F.count("*").alias("size"))
    before = sizes.select("__part", F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per range
    w = Window.partitionBy("__part").orderBy(*order)
    return held.join(F.broadcast(before), "__part").withColumn("n", F.row_number().over(w) + F.col("before")).drop("__part", "before")


def attribute_lookup(points: DataFrame, sections: DataFrame, chapters: DataFrame, default: str) -> DataFrame:
    """Points with the topic of their chapter. points (point, section_id), sections (section_id, chapter_id), chapters (chapter_id, topic)."""
    return points.join(sections, "section_id", "left").join(chapters, "chapter_id", "left").withColumn("topic", F.coalesce("topic", F.lit(default)))


def fill_missing(points: DataFrame, looked_up: DataFrame, default: str) -> DataFrame:
    """Only points without a difficulty take what was looked up; the others stay as they are."""
    lack = F.coalesce(F.col("difficulty"), F.lit(0)) == 0
    filled = points.where(lack).drop("difficulty", "topic").join(looked_up, "point", "left").withColumn("topic", F.coalesce("topic", F.lit(default)))
    return filled.unionByName(points.where(~lack), allowMissingColumns=True)


def resolve_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    n = nodes.select("uri").distinct()
    return edges.join(n, edges.src == n.uri, "left_semi").join(n, edges.dst == n.uri, "left_semi")


def route(edges: DataFrame, marks: dict[str, str], default: str = "other") -> DataFrame:
    """Edges with the kinds of their ends, by a mark in the URI."""

    def kind(c):
        out = None
        for name, mark in marks.items():
            out = F.when(F.contains(c, F.lit(mark)), name) if out is None else out.when(F.contains(c, F.lit(mark)), name)
        return out.otherwise(default)

    return edges.withColumns({"src_kind": kind("src"), "dst_kind": kind("dst")})


def in_unit_target(points: DataFrame, sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """(point, target): the section where there is one, else the chapter; neither: no row."""
    s, c = sections.select(F.col("id").alias("s")), chapters.select(F.col("id").alias("c"))
    j = points.join(s, points.section_id == s.s, "left").join(c, points.chapter_id == c.c, "left")
    return j.select("point", F.coalesce("s", "c").alias("target")).where("target is not null")


def defines(statements: DataFrame, concepts: DataFrame, suffix: str = "的定义") -> DataFrame:
    """(statement, concept): a statement named like a concept with the suffix."""
    s = statements.select(F.col("uri").alias("statement"), F.regexp_replace("label", f"{suffix}$", "").alias("label"))
    return s.join(concepts.select(F.col("uri").alias("concept"), "label"), "label").select("statement", "concept")


def label_pairs_to_uris(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, rel_type, dst) from pairs of labels, within the same batch. pairs (batch, from, rel_type, to), nodes (batch, label, uri)."""
    a = nodes.select("batch", F.col("label").alias("from"), F.col("uri").alias("src"))
    b = nodes.select("batch", F.col("label").alias("to"), F.col("uri").alias("dst"))
    return pairs.join(a, ["batch", "from"]).join(b, ["batch", "to"]).select("src", "rel_type", "dst")


def array_edges(rows: DataFrame, key: str, array: str, rel_type: str) -> DataFrame:
    """One edge per element of an array column."""
    return rows.select(F.col(key).alias("src"), F.lit(rel_type).alias("rel_type"), F.explode(array).alias("dst"))


def with_content(statements: DataFrame, contents: DataFrame) -> DataFrame:
    """Statements with their content, '' without one."""
    return statements.join(contents, "uri", "left").withColumn("content", F.coalesce("content", F.lit("")))


def same_label(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, a_uri, b_uri) of one label under different URIs in two graphs. All pairs of a label are the result, so they
    are made in as many tasks as there are, and those of a frequent label part against part."""
    x, y = a.select("label", F.col("uri").alias("a_uri")), b.select("label", F.col("uri").alias("b_uri"))
    pairs = x.groupBy("label").count().join(y.groupBy("label").agg(F.count("*").alias("m")), "label").agg(F.sum(F.col("count").cast("double") * F.col("m"))).first()[0] or 0
    left, right, _ = cells(x, y, "label", (F.col("a_uri"), F.col("b_uri")), (PAIR_ROWS, PAIR_ROWS))
    tasks = max(1, int(pairs // PAIR_ROWS**2) + 1)
    key = ["label", "__i", "__j"]
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key).where("a_uri <> b_uri").select("label", "a_uri", "b_uri")


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, diff, ok) of two metric tables (metric, value); a missing one counts 0."""
    j = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    z = j.select("metric", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return z.withColumn("diff", F.col("a") - F.col("b")).withColumn("ok", F.col("diff") == 0)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src").alias("uri")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "uri", "left_anti")


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "both", rel_type: str | None = None) -> DataFrame:
    """(seed, rel_type, node) one hop out, in or both ways, of one type if stated."""
    e = edges if rel_type is None else edges.where(F.col("rel_type") == rel_type)
    out = e.join(seeds, e.src == seeds.seed).select("seed", "rel_type", F.col("dst").alias("node"))
    into = e.join(seeds, e.dst == seeds.seed).select("seed", "rel_type", F.col("src").alias("node"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def entity_card(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the sorted distinct (type, target) of their edges; [] without one."""
    links = edges.groupBy(F.col("src").alias("uri")).agg(F.sort_array(F.collect_set(F.struct("rel_type", "dst"))).alias("links"))
    return nodes.join(links, "uri", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<rel_type:string,dst:string>>")))


def triple_card(triples: DataFrame) -> DataFrame:
    """(s, infobox): a map from predicate to the sorted values."""
    one = triples.groupBy("s", "p").agg(F.sort_array(F.collect_list("o")).alias("vs"))
    return one.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "vs")))).alias("infobox"))


def context_text(literals: DataFrame, edges: DataFrame, labels: DataFrame, chars: int = 20) -> DataFrame:
    """(node, context): the first ``chars`` characters of each literal and neighbour label, in order, joined by spaces."""
    near = edges.join(labels, edges.dst == labels.node).select(edges.src.alias("node"), "label")
    words = literals.select("node", F.col("label")).union(near).select("node", F.substring("label", 1, chars).alias("w"))
    return words.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("context"))


def instances_of_all(member: DataFrame, classes: list) -> DataFrame:
    """Instances of every one of the classes. member (node, cls)."""
    return member.where(F.col("cls").isin(*classes)).groupBy("node").agg(F.count_distinct("cls").alias("n")).where(F.col("n") == len(set(classes))).select("node")


def class_pairs(member: DataFrame) -> DataFrame:
    """(c1, c2, n): distinct instances shared by each pair of classes."""
    return pairs_within(member, "node", F.col("cls")).groupBy(F.col("lo").alias("c1"), F.col("hi").alias("c2")).agg(F.count("*").alias("n"))


def together(rows: DataFrame, group: str, node: str) -> DataFrame:
    """(src, dst): nodes that stand in a group together, each pair once, src below dst."""
    return pairs_within(rows, group, F.col(node)).select(F.col("lo").alias("src"), F.col("hi").alias("dst")).distinct()


def other_kinds(rows: DataFrame, group: str, node: str, kind: str) -> DataFrame:
    """(src, dst): nodes of different kinds that stand in a group together, each pair once, src below dst."""
    met = pairs_within(rows, group, F.struct(F.col(node).alias("node"), F.col(kind).alias("kind"))).where("lo.kind <> hi.kind and lo.node < hi.node")
    return met.select(F.col("lo.node").alias("src"), F.col("hi.node").alias("dst")).distinct()


def with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, null without one. labels (node, label), one row per node."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("src_label")), labels.select(F.col("node").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def recommend(edges: DataFrame, seeds: DataFrame, mastered: DataFrame, limit: int) -> DataFrame:
    """(user, node, rank): neighbours of what a user has, without what the user has, by number of ways, then name.

    The users of a node go along its edges as lists and are counted where the edges to a target meet, so there is no row for
    each user and edge to be sent or kept.
    """
    hot = parts(seeds, "node", USERS)
    part = F.pmod(F.xxhash64("user"), F.coalesce("__parts", F.lit(1)))
    none = F.array_repeat(F.lit(None).cast(seeds.schema["user"].dataType), (F.count("*") - F.count("user")).cast("int"))
    users = seeds.where("node is not null").join(hot, F.col("node") == F.col("__key"), "left").groupBy("node", part).agg(F.concat(F.collect_list("user"), none).alias("users"))
    met = edges.join(users.select(F.col("node").alias("src"), "users"), "src").select(F.col("dst").alias("node"), "users").repartition("node")
    ways = met.select(F.explode("users").alias("user"), "node").groupBy("user", "node").agg(F.count("*").alias("ways"))
    left = ways.join(mastered.select("user", "node").distinct(), ["user", "node"], "left_anti")
    w = Window.partitionBy("user").orderBy(F.desc("ways"), "node")
    return left.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select("user", "node", "ways", "rank")


def enriched(linked: DataFrame, labels: DataFrame, edges: DataFrame, chars: int = 20) -> DataFrame:
    """Linked nodes (id, node) with their label, their one-hop neighbours either way (sorted labels) and a context
    text: the label and the first ``chars`` characters of each neighbour's, joined by spaces. labels (node, label)."""
    seeds = linked.select(F.col("node").alias("seed")).distinct()
    near = neighbours(edges.withColumn("rel_type", F.lit("")), seeds).join(labels, "node")
    around = near.groupBy(F.col("seed").alias("node")).agg(F.sort_array(F.collect_list("label")).alias("neighbours"))
    out = linked.join(labels, "node", "left").join(around, "node", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
    return out.withColumn("context", F.concat_ws(" ", "label", F.transform("neighbours", lambda x: F.substring(x, 1, chars))))


def reviewed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of approved rows, nodes of new_kp rows)."""
    yes = results.where("status = 'approved' and concept is not null").select(F.col("id").alias("src"), F.lit("MATCHES").alias("rel_type"), F.col("concept").alias("dst"))
    return yes, results.where("status = 'new_kp'").select(F.col("id").alias("uri"), "label").distinct()


def same_as(triples: DataFrame, predicate: str, targets: DataFrame) -> DataFrame:
    """(s, o) of the predicate for the stated objects."""
    return triples.where(F.col("p") == predicate).join(targets.select("o").distinct(), "o", "left_semi").select("s", "o")


def class_ids(concepts: DataFrame, existing: DataFrame, new: DataFrame, default: str) -> DataFrame:
    """Concepts with class_id: an existing class, else a new one, else the default. existing and new (label, id)."""
    e, n = (x.groupBy("label").agg(F.min("id").alias(k)).withColumnRenamed("label", f"{k}_l") for x, k in ((existing, "e"), (new, "n")))
    j = concepts.join(e, concepts.cls == e.e_l, "left").join(n, concepts.cls == n.n_l, "left")
    return j.select(*concepts.columns, F.coalesce("e", "n", F.lit(default)).alias("class_id"))


def outline(headings: DataFrame, group: str, order: str, kind: str, text: str) -> DataFrame:
    """Headings with chapter and section: a chapter starts its count of sections anew; what comes before any is chapter 0."""
    w = Window.partitionBy(group).orderBy(order)
    c = headings.withColumn("chapter", F.sum((F.col(kind) == "chapter").cast("long")).over(w))
    s = Window.partitionBy(group, "chapter").orderBy(order)
    return c.withColumn("section", F.sum((F.col(kind) != "chapter").cast("long")).over(s)).withColumn("chapter_name", F.last(F.when(F.col(kind) == "chapter", F.col(text)), ignorenulls=True).over(w))


def continue_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """New (section, label) rows that are not there yet, once each, numbered on after the largest old ``seq``."""
    fresh = new.select("section", "label").distinct().join(old, ["section", "label"], "left_anti")
    top = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    return running_number(fresh, ["section", "label"]).crossJoin(F.broadcast(top)).select("section", "label", (F.col("n") + F.col("top")).alias("seq"))


def stage_ranges(firsts: DataFrame, last_page: int) -> DataFrame:
    """(book, stage, first, last): a stage runs to the page before the next one, the last to the end. firsts (book, stage, page)."""
    m = firsts.groupBy("book", "stage").agg(F.min("page").alias("first"))
    w = Window.partitionBy("book").orderBy("first", "stage")
    return m.withColumn("last", F.coalesce(F.lead("first").over(w) - 1, F.lit(last_page)))


def page_chunks(pages: DataFrame, size: int) -> DataFrame:
    """(doc, chunk, first, last, text): runs of ``size`` pages with their texts joined. pages (doc, page, text)."""
    w = Window.partitionBy("doc").orderBy("page")
    c = pages.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("doc", "chunk").agg(F.min("page").alias("first"), F.max("page").alias("last"), joined.alias("text"))


def pack_paragraphs(text, most: int = 8000, sep: str = "\n\n"):
    """A text of at most ``most`` characters as it is; else its paragraphs, which blank lines part, packed in order: a
    part takes the next one while it stays within ``most``, each paragraph counting with its separator, and a longer
    paragraph is a part of its own. Parts are trimmed. Null stays null."""
    size = lambda x: F.char_length(x) + len(sep)
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("last"), F.lit(0).alias("used"))

    def add(acc, p):
        fits = acc["used"] + size(p) <= most
        flushed = F.when(acc["used"] == 0, acc["parts"]).otherwise(F.array_append(acc["parts"], acc["last"]))
        return F.when(fits, F.struct(acc["parts"].alias("parts"), F.concat(acc["last"], p, F.lit(sep)).alias("last"), (acc["used"] + size(p)).alias("used"))).otherwise(
            F.struct(flushed.alias("parts"), F.concat(p, F.lit(sep)).alias("last"), size(p).alias("used"))
        )

    packed = F.aggregate(F.split(text, sep), empty, add, lambda acc: F.array_append(acc["parts"], acc["last"]))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(F.transform(packed, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with ``batch``, 0, 1, ... of ``size`` rows each in the stated order."""
    return running_number(rows, order).withColumn("batch", F.floor((F.col("n") - 1) / size))
