"""Voting and fusion over recorded responses (V1-V13). A response pair has (d1, c1, d2, c2): two decisions, two confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import dealt


def pivot_responses(responses: DataFrame, primary: str, secondary: str) -> DataFrame:
    """(item_key, model, decision, confidence) to one row per item with d1, c1, d2, c2."""
    m = lambda name, col: F.max(F.when(F.col("model") == name, F.col(col)))
    return responses.groupBy("item_key").agg(m(primary, "decision").alias("d1"), m(primary, "confidence").alias("c1"), m(secondary, "decision").alias("d2"), m(secondary, "confidence").alias("c2"))


def consensus(pairs: DataFrame, weights: tuple[float, float] = (0.4, 0.6), threshold: float = 0.5, penalty: float = 0.7, weighted: bool = True) -> DataFrame:
    """V1, V2: adds consensus, result, confidence. Equal decisions give the mean confidence; else, unless ``weighted`` is off,
    the side of more weight wins if its weight passes the threshold, with its confidence times the penalty."""
    same = F.col("d1").isNotNull() & F.col("d1").eqNullSafe(F.col("d2"))
    yes = F.when(F.col("d1"), weights[0]).otherwise(0.0) + F.when(F.col("d2"), weights[1]).otherwise(0.0)
    differ = F.col("d1").isNotNull() & F.col("d2").isNotNull() & (F.col("d1") != F.col("d2"))
    passes = differ & (yes > threshold) if weighted else F.lit(False)
    result = F.when(same, F.col("d1")).when(passes, F.lit(True))
    conf = F.when(same, (F.col("c1") + F.col("c2")) / 2).when(passes, F.when(F.col("d1"), F.col("c1")).otherwise(F.col("c2")) * penalty).otherwise(0.0)
    return pairs.withColumns({"consensus": F.coalesce(same, F.lit(False)) | F.coalesce(passes, F.lit(False)), "result": result, "confidence": F.round(conf, 6)})


def list_consensus(pairs: DataFrame) -> DataFrame:
    """V3: (l1, c1, l2, c2): both lists hold something: the primary's list with the mean confidence."""
    ok = F.coalesce((F.size("l1") > 0) & (F.size("l2") > 0), F.lit(False))
    return pairs.withColumns({"consensus": ok, "result": F.when(ok, F.col("l1")), "confidence": F.when(ok, (F.col("c1") + F.col("c2")) / 2).otherwise(0.0)})


def prerequisite_vote(pairs: DataFrame, high: float = 0.8, low: float = 0.6) -> DataFrame:
    """V4: relation of two yes: PREREQUISITE from ``high`` on, PREREQUISITE_CANDIDATE from ``low`` on, else null."""
    mean = (F.col("c1") + F.col("c2")) / 2
    both = F.coalesce(F.col("d1") & F.col("d2"), F.lit(False))
    return pairs.withColumns({"mean": F.round(mean, 6), "relation": F.when(both & (mean >= high), "PREREQUISITE").when(both & (mean >= low), "PREREQUISITE_CANDIDATE")})


def match_vote(pairs: DataFrame, min_conf: float | None = None) -> DataFrame:
    """V5: two yes give the mean; a threshold only if stated."""
    mean = (F.col("c1") + F.col("c2")) / 2
    ok = F.coalesce(F.col("d1") & F.col("d2"), F.lit(False))
    ok = ok if min_conf is None else ok & (mean >= min_conf)
    return pairs.withColumns({"matched": ok, "confidence": F.when(ok, F.round(mean, 6)).otherwise(0.0)})


def edge_type(votes: DataFrame, high: float = 0.8) -> DataFrame:
    """V6: consensus rows whose result is yes, typed by confidence."""
    return votes.where(F.col("consensus") & F.col("result")).withColumn("rel_type", F.when(F.col("confidence") >= high, "PREREQUISITE").otherwise("PREREQUISITE_CANDIDATE"))


def fuse(order: DataFrame, definition: DataFrame, vote: DataFrame) -> DataFrame:
    """V7: (src, dst, rel_type, confidence) of three edge sets (src, dst, conf, ord; vote also rel_type).

    Each set counts once per pair, by its first row. Order with definition: PREREQUISITE 0.9 whatever the vote; either with a
    yes vote: min(its confidence + 0.1, 1); one source alone keeps its own row.
    """
    one = lambda df, k, *cols: df.groupBy("src", "dst").agg(F.min_by(F.struct(*cols), "ord").alias(k))
    j = one(order, "o", "conf").join(one(definition, "d", "conf"), ["src", "dst"], "full_outer").join(one(vote, "v", "conf", "rel_type"), ["src", "dst"], "full_outer")
    o, d, v = (F.col(x).isNotNull() for x in "odv")
    conf = F.when(o & d, 0.9).when(o & v, F.least(F.col("o.conf") + 0.1, F.lit(1.0))).when(d & v, F.least(F.col("d.conf") + 0.1, F.lit(1.0))).otherwise(F.coalesce("o.conf", "d.conf", "v.conf"))
    rel = F.when(o & d, "PREREQUISITE").when((o | d) & v, "PREREQUISITE").when(o, "TEACHES_BEFORE").when(d, "PREREQUISITE").otherwise(F.col("v.rel_type"))
    return j.select("src", "dst", rel.alias("rel_type"), F.round(conf, 6).alias("confidence"))


def best_with_twin(edges: DataFrame) -> DataFrame:
    """V8: of each (src, dst) the row of highest confidence (then first type), and its twin PREREQUISITE_ON for prerequisites.
    The edges are sorted for that, so they are dealt by their number first, and the twins are made of the rows at hand."""
    best = dealt(edges, "src", "dst").groupBy("src", "dst").agg(F.min(F.struct(-F.col("confidence"), "rel_type")).alias("b")).select("src", "dst", F.col("b.rel_type").alias("rel_type"), (-F.col("b.col1")).alias("confidence"))
    types = F.when(F.col("rel_type") == "PREREQUISITE", F.array("rel_type", F.lit("PREREQUISITE_ON"))).otherwise(F.array("rel_type"))
    return best.select("src", "dst", F.explode(types).alias("rel_type"), "confidence")


def assign_classes(items: DataFrame, existing: DataFrame, fallback: str) -> tuple[DataFrame, DataFrame]:
    """V9: items (id, cls, parent, ord) with is_new, and the table of new classes: first item of each wins, parent by fallback."""
    e = existing.select(F.col("cls").alias("known")).distinct()
    j = items.join(e, items.cls == e.known, "left").withColumn("is_new", F.col("known").isNull()).drop("known")
    new = j.where("is_new and cls is not null").groupBy("cls").agg(F.min_by("parent", F.struct("ord", "id")).alias("parent")).withColumn("parent", F.coalesce("parent", F.lit(fallback)))
    return j, new


def statements(concepts: DataFrame, responses: DataFrame, template: str = "%s") -> DataFrame:
    """A statement per concept (uri, label): the recorded definition, else the default text."""
    r = responses.groupBy("uri").agg(F.min_by("definition", "ord").alias("definition"))
    return concepts.join(r, "uri", "left").select("uri", "label", F.coalesce("definition", F.format_string(template, "label")).alias("content"))


def topic_correction(matches: DataFrame, has_type: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, topic): the topic of the matched concept's class where one is known, else its own. has_type (concept, cls), topics (cls, topic2)."""
    t = has_type.join(topics, "cls").groupBy("concept").agg(F.min("topic2").alias("topic2"))
    return matches.join(t, "concept", "left").select("id", F.coalesce("topic2", "topic").alias("topic"))
