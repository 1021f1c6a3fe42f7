"""Learner progress and lesson queries (A25, J38, L*). Progress has (user, entity, status, score, ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Users and entities that meet in one block.
USER_BLOCK, ENTITY_BLOCK = 16_384, 1024


def latest(progress: DataFrame) -> DataFrame:
    """The last row of each (user, entity); ties in time go to the larger event_id."""
    return progress.groupBy("user", "entity").agg(F.max(F.struct("ts", "event_id", "status", "score")).alias("x")).select("user", "entity", "x.status", "x.score", "x.ts")


def status_counts(progress: DataFrame) -> DataFrame:
    """Per user the counts of mastered, in_progress and all other rows."""
    return progress.groupBy("user").agg(F.count_if(F.col("status") == "mastered").alias("mastered"), F.count_if(F.col("status") == "in_progress").alias("in_progress"), F.count_if(~F.coalesce(F.col("status").isin("mastered", "in_progress"), F.lit(False))).alias("rest"), F.count("*").alias("total"))


def weak_points(progress: DataFrame, below: int) -> DataFrame:
    """(user, entity, score): latest scores under the threshold."""
    return latest(progress).where(F.col("score") < below).select("user", "entity", "score")


def weak_roll_up(progress: DataFrame, below: int) -> DataFrame:
    """Per entity the learners below the threshold and their mean score."""
    return weak_points(progress, below).groupBy("entity").agg(F.count_distinct("user").alias("learners"), F.round(F.avg("score"), 4).alias("avg_score"))


def each_user(users: DataFrame, entities: DataFrame) -> DataFrame:
    """(user, entity): every stated user with every entity, of which no side has a bound: blocks of users meet blocks of
    entities, an entity block as one array, by the numbers of both."""
    u, e = users.select("user").distinct(), entities.select("entity").distinct()
    rows, cols = (max(1, -(-df.count() // size)) for df, size in ((u, USER_BLOCK), (e, ENTITY_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = e.groupBy(block("entity", cols).alias("j")).agg(F.collect_list("entity").alias("some")).withColumn("i", each(rows))
    return u.withColumn("i", block("user", rows)).withColumn("j", each(cols)).join(lists, ["i", "j"]).select("user", F.explode("some").alias("entity"))


def next_recommended(progress: DataFrame, needs: DataFrame, users: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(user, entity): the points that a user has not mastered, but all of whose prerequisites. needs (src prerequisite,
    dst); ``points`` (entity) are those that ``needs`` names if they are not given. A point without prerequisites is for
    everyone who has not mastered it, so also for a user of whom nothing is recorded.

    Counted, not tried: a user has all prerequisites of a point when as many of them are mastered as it has.
    """
    done = latest(progress).where("status = 'mastered'").select("user", "entity")
    need = needs.select("src", "dst").distinct()
    every = need.select(F.col("src").alias("entity")).union(need.select("dst")) if points is None else points.select("entity")
    total = need.groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("n"))
    have = need.join(done, need.src == done.entity).groupBy("user", F.col("dst").alias("entity")).agg(F.count("*").alias("m"))
    later = have.join(total, "entity").where("m = n").select("user", "entity").join(users.select("user"), "user", "left_semi")
    if points is not None:
        later = later.join(every, "entity", "left_semi")
    first = each_user(users, every.distinct().join(total, "entity", "left_anti"))
    return later.unionByName(first).join(done, ["user", "entity"], "left_anti")


def full_progress(users: DataFrame, entities: DataFrame, progress: DataFrame) -> DataFrame:
    """Every user with every entity, ``not_started`` where nothing is recorded."""
    return each_user(users, entities).join(latest(progress).select("user", "entity", "status"), ["user", "entity"], "left").withColumn("status", F.coalesce("status", F.lit("not_started")))


def by_subject(progress: DataFrame) -> DataFrame:
    """Per user and subject, and per user over all (subject null), the mastered and all rows."""
    return progress.rollup("user", "subject").agg(F.count_if(F.col("status") == "mastered").alias("mastered"), F.count("*").alias("total"), F.grouping_id().alias("g")).where("g < 3").drop("g")
