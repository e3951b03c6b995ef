import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import lifecycle, reports
from mnemospark.plans import requests as plans
from mnemospark.session import new_folder
from mnemospark.streaming import live

OLD = dt.datetime(2024, 1, 1)
SCHEMA = (
    "id string, user_id string, project_id string, content string, memory_type string,"
    "importance_score double, decay_rate double, access_count int, created_at timestamp,"
    "last_accessed timestamp, embedding array<float>"
)


def memories(spark, n=6):
    rows = [
        (f"m{i}", f"u{i % 2}", None, f"fact {i}", "general", 0.3 + 0.1 * i, 0.1, i % 2, OLD, OLD,
         [1.0 if j == i else 0.0 for j in range(n)])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def arrivals(spark, frames):
    """Write each frame as one file of a stream read file by file, in order."""
    path = new_folder(spark, "arrivals")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, spark):
    stream = (
        writer.option("checkpointLocation", new_folder(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return stream


def as_rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_access_stream_equals_batch(spark):
    base = memories(spark)
    path = new_folder(spark, "memories")
    live.create_live_table(base, path)
    parts = [
        spark.createDataFrame([("m0", dt.datetime(2024, 1, 2)), ("m1", dt.datetime(2024, 1, 3))], "memory_id string, ts timestamp"),
        spark.createDataFrame([("m0", dt.datetime(2024, 1, 5)), ("none", dt.datetime(2024, 1, 5))], "memory_id string, ts timestamp"),
        spark.createDataFrame([("m0", dt.datetime(2024, 1, 4)), ("m5", dt.datetime(2024, 1, 4))], "memory_id string, ts timestamp"),
    ]
    run(live.access_stream(arrivals(spark, parts), path), spark)
    batch = lifecycle.reinforce(base, parts[0].unionByName(parts[1]).unionByName(parts[2]))
    columns = ("id", "importance_score", "access_count", "last_accessed")
    assert as_rows(live.current_memories(spark, path), *columns) == as_rows(batch, *columns)
    compacted = new_folder(spark, "compacted")
    live.compact(spark, path, compacted)
    assert as_rows(live.current_memories(spark, compacted), *columns) == as_rows(batch, *columns)
    first_only = lifecycle.reinforce(base, parts[0])
    seen = live.current_memories(spark, path, "access", before=1)
    assert as_rows(seen, *columns) == as_rows(first_only, *columns)


def test_ingest_stream_equals_batch(spark, as_of):
    base = memories(spark)
    path = new_folder(spark, "memories")
    live.create_live_table(base, path)
    raw = [
        '[{"content":"fact 0"},{"content":"new a","memory_type":"decision"}]',
        "not json",
        '[{"content":"new a"},{"content":"no vector"},{"content":"new b","importance_score":0.8}]',
    ]
    rows = [(i, "u0", None, r) for i, r in enumerate(raw)]
    schema = "completion_id int, user_id string, project_id string, raw string"
    texts = {"fact 0": [1.0, 0, 0, 0, 0, 0], "new a": [0, 0, 0, 0, 0.6, 0.8], "new b": [0, 0.7, 0.7, 0, 0, 0]}
    vectors = spark.createDataFrame(
        [(t, [float(x) for x in v]) for t, v in texts.items()], "text string, embedding array<float>"
    ).select(F.sha2("text", 256).alias("text_key"), "embedding")

    def save(before, batch):
        return plans.ingest_completions(before, batch, vectors, as_of)

    parts = [spark.createDataFrame([r], schema) for r in rows]
    run(live.ingest_stream(arrivals(spark, parts), path, save), spark)
    whole = plans.ingest_completions(base, spark.createDataFrame(rows, schema), vectors, as_of)
    table = plans.after_ingest(base, whole)
    columns = ("id", "content", "importance_score", "access_count")
    got = as_rows(live.current_memories(spark, path), *columns)
    assert got == as_rows(table, *columns) and len(got) == 8
    assert [r.content for r in whole.failed.collect()] == ["no vector"]


def test_a_batch_is_seen_as_a_whole(spark, as_of, monkeypatch):
    """A batch that fails between its inserts and its recalls leaves nothing to be seen, and runs again."""
    base = memories(spark)
    path = new_folder(spark, "memories")
    live.create_live_table(base, path, buckets=4)
    schema = "completion_id int, user_id string, project_id string, raw string"
    rows = [(0, "u0", None, '[{"content":"fact 0"},{"content":"new a"}]')]
    texts = [("fact 0", [1.0, 0, 0, 0, 0, 0]), ("new a", [0, 0, 0, 0, 0.6, 0.8])]
    vectors = spark.createDataFrame(
        [(t, [float(x) for x in v]) for t, v in texts], "text string, embedding array<float>"
    ).select(F.sha2("text", 256).alias("text_key"), "embedding")
    state = new_folder(spark, "state")

    def save(before, batch):
        return plans.ingest_completions(before, batch, vectors, as_of)

    def attempt():
        writer = live.ingest_stream(stream, path, save).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()

    stream = arrivals(spark, [spark.createDataFrame(rows, schema)])
    columns = ("id", "importance_score", "access_count")
    write = live._write_log

    def failing(rows, where, *rest):
        if where.endswith("/recalls"):
            raise RuntimeError("lost")
        write(rows, where, *rest)

    monkeypatch.setattr(live, "_write_log", failing)
    with pytest.raises(Exception, match="lost"):
        attempt()
    assert spark.read.parquet(f"{path}/inserts").count() == 1
    assert as_rows(live.current_memories(spark, path), *columns) == as_rows(base, *columns)
    monkeypatch.setattr(live, "_write_log", write)
    attempt()
    whole = plans.ingest_completions(base, spark.createDataFrame(rows, schema), vectors, as_of)
    got = as_rows(live.current_memories(spark, path), *columns)
    assert got == as_rows(plans.after_ingest(base, whole), *columns) and len(got) == 7


def test_a_batch_reads_the_buckets_of_its_users(spark):
    path = new_folder(spark, "memories")
    live.create_live_table(memories(spark), path, buckets=16)
    added = memories(spark).withColumn("id", F.concat(F.lit("n"), "id"))
    live._write_inserts(added, path, "other", 0, 16)
    live._commit(spark, path, "other", 0)
    asking = spark.createDataFrame([("u1",)], "user_id string")
    seen = live.current_memories(spark, path, users=asking)
    assert seen.filter("user_id = 'u1'").count() == 6
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) >= 2


def test_a_replayed_log_counts_once(spark):
    base = memories(spark)
    rows = [(k, f"m{k % 4}", OLD + dt.timedelta(days=1 + k)) for k in range(9)]
    log = spark.createDataFrame(rows, "event_id long, memory_id string, ts timestamp")
    want = lifecycle.reinforce(base, log)
    columns = ("id", "importance_score", "access_count", "last_accessed")
    assert as_rows(lifecycle.reinforce(base, log.unionByName(log)), *columns) == as_rows(want, *columns)
    for lateness in (None, "30 days"):
        path = new_folder(spark, "memories")
        live.create_live_table(base, path)
        run(live.access_stream(arrivals(spark, [log, log]), path, lateness=lateness), spark)
        assert spark.read.parquet(f"{path}/commits").filter("source = 'access'").count() >= 2
        assert as_rows(live.current_memories(spark, path), *columns) == as_rows(want, *columns)
    out = new_folder(spark, "out")
    counts = live.access_counts_stream(arrivals(spark, [log, log]))
    run(live.update_sink(counts, out), spark)
    got = live.latest_updates(spark, out, counts.schema, "id")
    assert as_rows(got, "id", "recalls") == [("m0", 3), ("m1", 2), ("m2", 2), ("m3", 2)]


def test_stats_stream_equals_batch(spark):
    base = memories(spark)
    halves = [base.filter("id <= 'm2'"), base.filter("id > 'm2'")]
    out = new_folder(spark, "out")
    result = live.stats_stream(arrivals(spark, halves))
    run(live.update_sink(result, out), spark)
    got = live.latest_updates(spark, out, result.schema, "user_id")
    assert as_rows(got, *got.columns) == as_rows(reports.memory_stats(base), *got.columns)


def test_windows_close_behind_the_watermark(spark):
    def at(hour, user):
        return ("x", user, 0.5, OLD + dt.timedelta(hours=hour))

    schema = "id string, user_id string, importance_score double, created_at timestamp"
    parts = [
        spark.createDataFrame([at(1, "u"), at(2, "u")], schema),
        spark.createDataFrame([at(30, "u")], schema),
        spark.createDataFrame([at(31, "u")], schema),
        # Too late: late rows are judged by the watermark before the last batch.
        spark.createDataFrame([at(3, "u")], schema),
        spark.createDataFrame([at(60, "v")], schema),
    ]
    closed = live.windowed_stats_stream(arrivals(spark, parts), "1 day", "1 hour")
    out = new_folder(spark, "out")
    run(closed.writeStream.outputMode("append").format("parquet").option("path", out), spark)
    rows = {(r.start, r.user_id): r.created for r in spark.read.parquet(out).collect()}
    assert rows == {(OLD, "u"): 2, (OLD + dt.timedelta(days=1), "u"): 2}


def test_forget_timers_equal_batch(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = memories(spark).drop("embedding")
        later = changes.filter("id = 'm2'").withColumn(
            "last_accessed", F.lit("2024-01-10 00:00:00").cast("timestamp")
        )
        # A row of another user moves event time far ahead.
        end = dt.datetime(2024, 6, 1)
        clock = changes.filter("id = 'm1'").withColumns(
            {"id": F.lit("clock"), "last_accessed": F.lit(str(end)).cast("timestamp")}
        )
        out = new_folder(spark, "out")
        due = live.forget_timer_stream(arrivals(spark, [changes, later, clock]))
        run(due.writeStream.outputMode("append").format("parquet").option("path", out), spark)
        got = {r.id: r.forget_at for r in spark.read.parquet(out).collect()}
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    current = changes.filter("id <> 'm2'").unionByName(later)
    want = {r.id: r.forget_at for r in live.forgotten_by(current, F.lit(str(end)).cast("timestamp")).collect()}
    assert set(got) == set(want) and len(want) >= 4
    for key, moment in want.items():
        assert abs((got[key] - moment).total_seconds()) <= 0.002


def test_forget_timers_ask_the_state_store_by_groups(spark):
    """Many memories of few groups; touched ones wait again, a string id and a null one stay themselves."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id bigint, importance_score double, decay_rate double, access_count int, last_accessed timestamp"

    def frame(rows):
        return spark.createDataFrame([(i, score, 0.1, 0, at) for i, score, at in rows], schema)

    def day(n):
        return OLD + dt.timedelta(days=n)

    big = 1 << 60
    first = [(big + i, 0.3, day(i % 3)) for i in range(60)] + [(None, 0.3, day(0)), (big, 0.3, day(0)), (7, 0.3, None)]
    frames = [
        frame(first),
        frame([(big + i, 0.9, day(5)) for i in range(0, 60, 2)] + [(big + 1, 0.3, day(1)), (big + 70, 0.01, day(5))]),
        frame([(big + 1, 0.3, day(40)), (big + 80, None, day(12))]),
        frame([(big + 90, None, day(22))]),
        frame([(big + 99, None, day(200))]),
    ]
    try:
        out = new_folder(spark, "out")
        due = live.forget_timer_stream(arrivals(spark, frames), groups=3)
        assert due.schema["id"].dataType.simpleString() == "bigint"
        run(due.writeStream.outputMode("append").format("parquet").option("path", out), spark)
        got = sorted((r.id is None, r.id or 0, r.forget_at) for r in spark.read.parquet(out).collect())
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    assert len(got) == len({row[:2] for row in got})
    current = {i: (i, score, at) for rows in frames for i, score, at in ((r.id, r.importance_score, r.last_accessed) for r in rows.collect())}
    current.pop(7)
    want = live.forgotten_by(frame(list(current.values())), F.lit(str(day(200))).cast("timestamp")).collect()
    want = sorted((r.id is None, r.id or 0, r.forget_at) for r in want)
    assert [row[:2] for row in got] == [row[:2] for row in want] and len(want) == 62
    assert all(abs((g[2] - w[2]).total_seconds()) <= 0.002 for g, w in zip(got, want))
