"""Structured Streaming over an events source (T1-T5). Streams run over what is there and end; their state is in checkpoints."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..scratch import shared_dir, write_table
from ..sources.stored import StoredTable

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream, with an event time that watermarks take. ``path`` is a file or a folder of Parquet files."""
    folder, _, name = path.rpartition("/")
    j = spark.sparkContext._jvm
    p = j.org.apache.hadoop.fs.Path(path)
    is_file = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(EVENTS)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)
    return raw.withColumn("time", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, each, mode: str = "update", at: str | None = None) -> None:
    at = at or f"{shared_dir(stream.sparkSession)}/graphloom/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def upsert_stream(spark: SparkSession, path: str, state: str | None = None, buckets: int = 16) -> DataFrame:
    """(user, entity, status, score) with the last write per key. Each micro-batch merges its last writes into a stored
    table, of which it rewrites only the buckets that they change; one that runs twice changes nothing, and there is
    nothing to fold when it is read. ``state`` is the folder of the checkpoint and the table: a stream that starts again on
    it goes on where it ended. None: a folder of its own."""
    base = state or f"{shared_dir(spark)}/graphloom/progress-{uuid.uuid4().hex}"
    status = F.when(F.col("event_type") == "purchase", "mastered").when(F.col("event_type").isin("click", "view"), "in_progress").otherwise("not_started")
    rows = source(spark, path).withWatermark("time", "1 day").select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("entity"), F.struct("ts", "event_id", status.alias("status"), F.floor("value").cast("long").alias("score")).alias("x"))
    at = f"{base}/table"
    j = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_layout/_SUCCESS")
    if not j.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(j):
        empty = spark.createDataFrame([], rows.schema)
        StoredTable.create(empty, at, ["user", "entity"], buckets)
    table = StoredTable(spark, at)
    _run(rows, lambda batch, number: table.merge_last(batch.groupBy("user", "entity").agg(F.max("x").alias("x")), "x"), "append", f"{base}/checkpoint")
    last = table.read()
    last = spark.createDataFrame([], rows.schema) if last is None else last
    return last.select("user", "entity", "x.status", "x.score")


def resumed(spark: SparkSession, path: str, keys: list[str], state: str | None = None, within: str = "3650 days") -> DataFrame:
    """The keys of a stream of events that a run met for the first time. The state is in the checkpoint under
    ``state``: what an earlier run there has completed does not come again."""
    base = state or f"{shared_dir(spark)}/graphloom/resume-{uuid.uuid4().hex}"
    run = uuid.uuid4().hex
    fresh = deduplicated(source(spark, path), keys, within).select(*keys)
    _run(fresh, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out-{run}/batch={n}"), "append", f"{base}/checkpoint")
    try:
        return spark.read.parquet(f"{base}/out-{run}").select(*keys)
    except AnalysisException:  # no batch had anything to do
        return spark.createDataFrame([], source(spark, path).select(*keys).schema)


def cost_stream(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """T4: running calls and cents per provider, with the alert once the cents pass the limit."""
    out = f"{shared_dir(spark)}/graphloom/cost-{uuid.uuid4().hex}"
    agg = source(spark, path).groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("calls"), F.sum(F.floor("value").cast("long")).alias("cents"))
    _run(agg, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}"))
    last = spark.read.parquet(out).groupBy("provider").agg(F.max(F.struct("n", "calls", "cents")).alias("x"))
    return last.select("provider", "x.calls", "x.cents", (F.col("x.cents") > limit).alias("over"))


def window_stream(spark: SparkSession, path: str) -> DataFrame:
    """T5: events per day and type; rows later than the watermark of two days are dropped, as the mode is update the rest show at once."""
    out = f"{shared_dir(spark)}/graphloom/windows-{uuid.uuid4().hex}"
    agg = source(spark, path).withWatermark("time", "2 days").groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    _run(agg, lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/k={k}"))
    last = spark.read.parquet(out).groupBy("w", "event_type").agg(F.max(F.struct("k", "n")).alias("x"))
    return last.select(F.col("w.start").alias("day"), "event_type", "x.n")


def deduplicated(stream: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    """Each key once within the watermark, also after a restart, as the state is in the checkpoint."""
    return stream.withWatermark("time", within).dropDuplicatesWithinWatermark(keys)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """T2 in batch: what has not been completed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


class TimedAnswers(StatefulProcessor):
    """Per key the last stored answer, as (microseconds, answer), and a timer for its end."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def _end(self, at: int) -> int:
        """The first whole millisecond at which nothing stored at ``at`` is given any more."""
        return -(-(at + self.ttl) // 1000)

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, answer double")

    def handleInputRows(self, key, rows, timerValues):
        many = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        at, answer = self.last.get() if self.last.exists() else (None, None)
        before, out = at, []
        for event, us, stored in zip(many["event_id"].tolist(), many["us"].tolist(), many["answer"].tolist(), strict=True):
            if stored == stored and stored is not None:
                if at is None or us >= at:
                    at, answer = us, stored
            else:
                hit = at is not None and 0 <= us - at < self.ttl
                out.append((key[0], event, "hit" if hit else "miss", answer if hit else None))
        if at is not None and at != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(at))
            self.last.update((at, answer))
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "outcome", "answer"]).astype({"answer": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "event_id": [None], "outcome": ["expired"], "answer": [None]}).astype({"event_id": "Int64", "answer": "float64"})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cache_stream(spark: SparkSession, path: str, stores: str, ttl: str, state: str | None = None) -> DataFrame:
    """(key, event_id, outcome, answer) of a stream of events, the keys being users: events that meet the condition
    ``stores`` put their value into a cache, all others ask it. A ``hit`` is answered from the last one stored at most ``ttl``
    before ("7 days"), else it is a ``miss``; a row ``expired`` says that the watermark has passed the end of an answer
    and that it has left the state. Events of a batch go by time; what comes in a later batch with an earlier time asks what
    is stored by then. ``state`` is the folder of the checkpoint and the output, from which a later run goes on.
    """
    base = state or f"{shared_dir(spark)}/graphloom/cache-{uuid.uuid4().hex}"
    length = spark.range(1).select(F.unix_micros(F.expr(f"timestamp_micros(0) + interval {ttl}"))).first()[0]
    rows = source(spark, path).where("user_id is not null and time is not null").withWatermark("time", "0 seconds")
    asked = rows.select(F.col("user_id").alias("key"), "event_id", "time", F.unix_micros("time").alias("us"), F.when(F.expr(stores), F.col("value")).alias("answer"))
    answers = asked.groupBy("key").transformWithStateInPandas(TimedAnswers(length), "key long, event_id long, outcome string, answer double", "append", "EventTime")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)  # the only store that keeps timers
    try:
        _run(answers, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/answers/batch={n}"), "append", f"{base}/checkpoint")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema("key long, event_id long, outcome string, answer double, batch int").parquet(f"{base}/answers").drop("batch")


def alive(cache: DataFrame, time: str, ttl: str, now=None) -> DataFrame:
    """Cached rows younger than ``ttl`` (an interval such as "7 days"); ``now`` is the time of the newest row unless stated."""
    return _aged(cache, time, ttl, now).where("not expired").drop("expired")


def purge(cache: DataFrame, time: str, ttl: str, now=None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by age: what stays in the cache is written anew, and one row counts both."""
    aged = _aged(cache, time, ttl, now)
    kept = write_table(aged.where("not expired").drop("expired"), "cache")
    return kept, aged.agg(F.count_if(~F.col("expired")).alias("kept"), F.count_if("expired").alias("removed"))


def _aged(cache: DataFrame, time: str, ttl: str, now) -> DataFrame:
    newest = cache.agg((F.max(time) if now is None else F.lit(now).cast(cache.schema[time].dataType)).alias("__now"))  # one row
    expired = ~F.coalesce(F.col(time) > F.col("__now") - F.expr(f"interval {ttl}"), F.lit(False))
    return cache.crossJoin(F.broadcast(newest)).withColumn("expired", expired).drop("__now")
