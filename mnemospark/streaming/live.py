"""Streaming forms of ingest, access tracking and statistics.

A live table is a folder with a ``base`` version of the memories and two logs of
what came since: ``inserts`` (new rows) and ``recalls`` (count and latest time
per memory). Base and inserts lie in buckets by a hash of the user, so a batch reads
the buckets of its own users only.

A micro-batch writes only its own changes, in a folder named by stream and batch id,
and at its end a mark in ``commits``. Readers look at marked batches alone: the inserts
and recalls of a batch become visible together, and a batch that fails between
them leaves nothing to be seen and is replaced when it runs again.
:func:`current_memories` merges base and logs; :func:`compact` writes the merge as the
base of a new live table, for instance in the daily sweep that rewrites the table anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from mnemospark.functions.decay import forget_time
from mnemospark.operators.lifecycle import apply_recalls, merge_recalls, roll_up_accesses
from mnemospark.operators.reports import memory_stats
from mnemospark.operators.saving import SavedBatch


#: Buckets of users in a live table, unless its creator chooses others.
BUCKETS = 64
#: Files that a bucket of the base is spread over at most, so that a large user is not one task.
SPREAD = 16


def create_live_table(memories: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the base, empty logs and the number of buckets."""
    spark = memories.sparkSession
    spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
    rows = memories.withColumn("bucket", _bucket(buckets)).repartition(F.col("bucket"), spread)
    rows.sortWithinPartitions("bucket", "user_id").write.partitionBy("bucket").parquet(f"{path}/base")
    _write_inserts(spark.createDataFrame([], memories.schema), path, "none", 0, buckets)
    none = spark.createDataFrame([], _recall_schema(memories.schema))
    _write_log(none, f"{path}/recalls", "none", 0)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")
    _commit(spark, path, "none", 0)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def _recall_schema(memories: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", memories["id"].dataType),
            T.StructField("recalls", T.LongType()),
            T.StructField("latest", memories["last_accessed"].dataType),
        ]
    )


def _write_log(rows: DataFrame, path: str, source: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/source={source}/batch={batch_id}")


def _write_inserts(rows: DataFrame, path: str, source: str, batch_id: int, buckets: int) -> None:
    writer = rows.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket")
    writer.parquet(f"{path}/inserts/source={source}/batch={batch_id}")


def _commit(spark: SparkSession, path: str, source: str, batch_id: int) -> None:
    """Mark a batch as whole; the last thing that a batch writes."""
    _write_log(spark.range(1).select(F.lit(True).alias("whole")).coalesce(1), f"{path}/commits", source, batch_id)


NUMBERED = [T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())]


def _read_log(
    spark: SparkSession, path: str, log: str, fields: list[T.StructField], source: str | None, before: int
) -> DataFrame:
    """Entries of committed batches, without those of ``source`` from batch ``before`` on."""
    marks = spark.read.schema(T.StructType([T.StructField("whole", T.BooleanType()), *NUMBERED]))
    seen = marks.parquet(f"{path}/commits").filter("whole").select("source", "batch")
    if source is not None:
        seen = seen.filter((F.col("source") != source) | (F.col("batch") < before))
    entries = spark.read.schema(T.StructType([*fields, *NUMBERED])).parquet(f"{path}/{log}")
    return entries.join(seen, ["source", "batch"], "left_semi").drop("source", "batch")


def current_memories(
    spark: SparkSession,
    path: str,
    source: str | None = None,
    before: int = 0,
    users: DataFrame | None = None,
) -> DataFrame:
    """Base and logs merged; with ``source`` as that stream saw it before a batch.

    With ``users`` only the buckets that hold them are read: partitions of base and
    inserts are left out by their number.
    """
    base = spark.read.parquet(f"{path}/base")
    inserts = _read_log(spark, path, "inserts", base.schema.fields, source, before)
    if users is not None:
        buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
        held = [r["bucket"] for r in users.select(_bucket(buckets).alias("bucket")).distinct().collect()]
        base, inserts = (t.filter(F.col("bucket").isin(held)) for t in (base, inserts))
    base, inserts = base.drop("bucket"), inserts.drop("bucket")
    recalls = _read_log(spark, path, "recalls", _recall_schema(base.schema).fields, source, before)
    return apply_recalls(base.unionByName(inserts), merge_recalls(recalls))


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the merged table as the base of a new live table."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
    create_live_table(current_memories(spark, path), new_path, buckets)


def ingest_stream(
    completions: DataFrame,
    path: str,
    save: Callable[[DataFrame, DataFrame], SavedBatch],
    source: str = "ingest",
) -> DataStreamWriter:
    """Save arriving completions (with user_id) into a live table.

    ``save(memories, batch)`` gives the inserts and recalls of the batch; it is given the
    memories of the batch's users and of those that share their buckets.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = current_memories(spark, path, source, batch_id, batch.select("user_id"))
        buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
        saved = save(before, batch)
        inserts = saved.inserts.select(
            *(F.col(f.name).cast(f.dataType) for f in before.schema if f.name in saved.inserts.columns)
        )
        _write_inserts(inserts, path, source, batch_id, buckets)
        _write_log(saved.recalls, f"{path}/recalls", source, batch_id)
        _commit(spark, path, source, batch_id)

    return completions.writeStream.foreachBatch(run)


def each_event_once(log: DataFrame, lateness: str | None = None) -> DataFrame:
    """A stream of accesses (event_id, memory_id, ts) without the events that came before.

    A log that is delivered again changes nothing. Event ids are kept for good, or, with
    ``lateness``, as long as their time is not that far behind the latest; events that
    arrive later than that are dropped, as no one knows any more whether they were counted.
    """
    if lateness is None:
        return log.dropDuplicates(["event_id"])
    return log.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def access_stream(
    log: DataFrame, path: str, source: str = "access", lateness: str | None = None
) -> DataStreamWriter:
    """Record the recalls of an arriving access log in a live table.

    The log has memory_id and ts. With an ``event_id``, too, an event that arrives
    again counts once, see :func:`each_event_once`.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        _write_log(roll_up_accesses(batch), f"{path}/recalls", source, batch_id)
        _commit(batch.sparkSession, path, source, batch_id)

    if "event_id" in log.columns:
        log = each_event_once(log, lateness).drop("event_id")
    return log.writeStream.foreachBatch(run)


def update_sink(result: DataFrame, path: str) -> DataStreamWriter:
    """Write the rows changed by each batch under its own number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return result.writeStream.outputMode("update").foreachBatch(write)


def latest_updates(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The last row written for every key."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    updates = spark.read.schema(full).parquet(path)
    row = F.max_by(F.struct(*(f.name for f in schema)), "batch").alias("row")
    return updates.groupBy(key).agg(row).select("row.*")


def access_counts_stream(log: DataFrame) -> DataFrame:
    """Running count and latest access per memory, for update or complete mode.

    Events (event_id) that arrive again count once.
    """
    if "event_id" in log.columns:
        log = each_event_once(log).drop("event_id")
    return roll_up_accesses(log)


def stats_stream(created: DataFrame) -> DataFrame:
    """Running statistics per user over created memories."""
    return memory_stats(created)


def windowed_stats_stream(created: DataFrame, window: str, lateness: str) -> DataFrame:
    """Created memories per user and time window; late rows beyond the watermark drop.

    State is bounded by the users active within one window and lateness.
    """
    return (
        created.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", window), "user_id")
        .agg(
            F.count("*").alias("created"),
            F.avg("importance_score").alias("avg_importance"),
        )
        .select("window.start", "window.end", "user_id", "created", "avg_importance")
    )


#: Groups of memories, by a hash of the id, that the timers are kept by. Fixed for the life of a stream.
TIMER_GROUPS = 4_096

#: What is known of a group; a due time is null where none is awaited (any more).
_KNOWN = pa.schema({"id": pa.string(), "accessed_us": pa.int64(), "due_ms": pa.float64()})


class _ForgetTimers(StatefulProcessor):
    """Keeps one due time per memory of a group and reports it when the watermark passes.

    A group has one timer, at the earliest of its due times, so the calls to the state
    store grow with the groups that a batch touches and not with its memories.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "memories binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        before = self._read()
        self._forget_timer(before)
        changed = pd.concat([before.iloc[:0], *(batch[_KNOWN.names] for batch in rows)])
        both = pd.concat([before.assign(touched=False), changed.assign(touched=True)], ignore_index=True)
        # The latest access counts; of equal ones the row that came last.
        after = both.sort_values("accessed_us", kind="stable").drop_duplicates("id", keep="last")
        return self._reported(after, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        return self._reported(self._read().assign(touched=False), watermark)

    def _reported(self, memories: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        """Report what is due, keep the rest and set the timer for it."""
        due, touched = memories["due_ms"], memories["touched"]
        # A row of this batch that is past already is reported at once: a timer would never fire.
        gone = (due < watermark) | (touched & (due <= watermark))
        left = memories[~gone | touched].copy()
        left.loc[gone & touched, "due_ms"] = None
        self._write(left)
        if gone.any():
            moments = pd.to_datetime(due[gone].astype("int64"), unit="ms", utc=True)
            yield pd.DataFrame({"id": memories.loc[gone, "id"], "forget_at": moments})

    def _read(self) -> pd.DataFrame:
        stored = self.known.get()
        if stored is None:
            return _KNOWN.empty_table().to_pandas()
        return pa.ipc.read_record_batch(pa.py_buffer(stored[0]), _KNOWN).to_pandas()

    def _write(self, memories: pd.DataFrame) -> None:
        if memories.empty:
            self.known.clear()
            return
        rows = pa.RecordBatch.from_pandas(memories[_KNOWN.names], schema=_KNOWN, preserve_index=False)
        self.known.update((rows.serialize().to_pybytes(),))
        if memories["due_ms"].notna().any():
            self.handle.registerTimer(int(memories["due_ms"].min()))

    def _forget_timer(self, memories: pd.DataFrame) -> None:
        if memories["due_ms"].notna().any():
            self.handle.deleteTimer(int(memories["due_ms"].min()))

    def close(self) -> None:
        pass


def forget_timer_stream(changes: DataFrame, lateness: str = "0 seconds", groups: int = TIMER_GROUPS) -> DataFrame:
    """Report each memory when event time reaches the moment it fades out.

    ``changes`` streams the current row of a memory whenever it is created or
    touched; its ``last_accessed`` is the event time, and rows without one are left out.
    Needs the RocksDB state store. State is one time per memory, kept in ``groups`` rows
    with a timer each: a batch reads and writes the groups of its own memories, as many of them at once.
    """
    # Timers work in milliseconds: round up, so that none fires early.
    due = F.ceil(F.unix_micros(forget_time()) / 1000.0)
    rows = (
        changes.filter(F.col("last_accessed").isNotNull())
        .withWatermark("last_accessed", lateness)
        .select(
            F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"),
            F.col("id").cast("string").alias("id"),
            "last_accessed",
            F.unix_micros("last_accessed").alias("accessed_us"),
            due.cast("double").alias("due_ms"),
        )
    )
    reported = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_ForgetTimers(),
        outputStructType="id string, forget_at timestamp",
        outputMode="Append",
        timeMode="EventTime",
    )
    return reported.select(F.col("id").cast(changes.schema["id"].dataType).alias("id"), "forget_at")


def forgotten_by(memories: DataFrame, as_of: Column) -> DataFrame:
    """Batch form of the timers: what has faded out by ``as_of``, and when."""
    return memories.select("id", forget_time().alias("forget_at")).filter(
        F.col("forget_at") <= as_of
    )
