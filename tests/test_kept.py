"""Tables that are kept up to date: split state and statistics."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import kept_stats, lifecycle, reports
from mnemospark.session import materialised, new_folder
from mnemospark.sources import split

DAY = dt.datetime(2024, 1, 1)
SCHEMA = (
    "id long, user_id string, content string, memory_type string, importance_score double, decay_rate double,"
    "access_count int, created_at timestamp, last_accessed timestamp, embedding array<float>"
)


def rows(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    made = [
        (
            first + k, f"u{rng.randrange(3)}", f"text {k}", rng.choice(["general", "decision", "pattern", None]), rng.random(), 0.1,
            rng.randrange(3), DAY + dt.timedelta(days=rng.randrange(12)), DAY + dt.timedelta(days=rng.randrange(30)), [float(k), 1.0],
        )
        for k in range(n)
    ]
    return spark.createDataFrame(made, SCHEMA)


def files(path):
    return {p.name: p.stat().st_mtime_ns for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def as_rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def test_state_changes_leave_the_vectors_alone(spark):
    memories = materialised(rows(spark, 60))
    path = new_folder(spark, "split")
    table = split.create(memories, path, buckets=4)
    assert as_rows(table.memories()) == as_rows(memories)
    vectors = files(f"{path}/vectors")
    log = spark.createDataFrame([(k % 50 * 2, DAY + dt.timedelta(days=40)) for k in range(90)], "memory_id long, ts timestamp")
    table = split.reinforce(table, log)
    want = lifecycle.reinforce(memories, log)
    assert as_rows(table.memories()) == as_rows(want)
    scores = spark.createDataFrame([(3, 0.125), (900, 1.0)], "id long, new_score double")
    gone = spark.createDataFrame([(4, "u0"), (5, "u1"), (6, "u2"), (901, "u0")], "id long, user_id string")
    table = split.delete(split.set_importance(table, scores), gone, check_owner=True)
    want = lifecycle.delete_by_id(lifecycle.set_importance(want, scores), gone, check_owner=True)
    assert as_rows(table.memories()) == as_rows(want)
    assert files(f"{path}/vectors") == vectors
    more = rows(spark, 10, seed=2, first=1000)
    table = split.insert(split.delete(table, gone), more)
    want = lifecycle.delete_by_id(want, gone).unionByName(more)
    assert as_rows(table.memories()) == as_rows(want)
    assert vectors.items() <= files(f"{path}/vectors").items()
    assert as_rows(split.current(spark, path).memories()) == as_rows(want) and split.current(spark, path).version == 5


def test_no_side_of_the_split_table_is_shuffled(spark):
    table = split.create(rows(spark, 60), new_folder(spark, "split"), buckets=4)
    plan = table.memories()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    log = spark.createDataFrame([(1, DAY)], "memory_id long, ts timestamp")
    joined = table.state.join(lifecycle.roll_up_accesses(log).hint("merge"), "id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Bucketed: true", plan)) == 1 and "embedding" not in plan
    assert "Exchange" not in plan[: plan.index("Bucketed: true")]


def test_kept_statistics_equal_the_table_after_every_batch(spark, as_of):
    def same(stats, table):
        got = {r.user_id: r for r in kept_stats.user_stats(stats).collect()}
        want = {r.user_id: r for r in reports.memory_stats(table).collect()}
        counts = {(r.user_id, r.memory_type): r.cnt for r in reports.count_by_type(table).collect()}
        assert set(got) == set(want)
        for user, row in want.items():
            mine = got[user]
            for name in ("total_memories", "oldest_memory", "newest_memory", "memories_at_risk"):
                assert mine[name] == row[name], name
            assert mine.avg_importance == pytest.approx(row.avg_importance, abs=1e-12)
            assert mine.memories_by_type == {t: n for (u, t), n in counts.items() if u == user and t is not None}

    table = materialised(rows(spark, 200))
    stats = kept_stats.start(table, kept=2)
    same(stats, table)
    # Deletions from both ends, more than are kept; then everything of a user; then new rows beyond the known ends.
    rng = random.Random(8)
    for step in range(5):
        if step in (0, 3):
            low, high = (2, 9) if step == 0 else (4, 6)
            inside = F.col("created_at").between(F.lit(str(DAY + dt.timedelta(days=low))).cast("timestamp"), F.lit(str(DAY + dt.timedelta(days=high))).cast("timestamp"))
            removed, added, after = table.filter(~inside), None, table.filter(inside)
        elif step == 1:
            removed, added = None, rows(spark, 60, seed=30, first=500)
            after = table.unionByName(added)
        elif step == 2:
            touched = F.col("id") % 3 == rng.randrange(3)
            removed = table.filter(touched)
            added = removed.withColumn("importance_score", F.col("importance_score") / 3)
            after = table.filter(~touched).unionByName(added)
        else:
            removed, added = table.filter("user_id = 'u1'"), rows(spark, 5, seed=40, first=900)
            after = table.filter("user_id <> 'u1'").unionByName(added)
        after = materialised(after)
        stats = kept_stats.update(stats, removed, added, after, kept=2)
        same(stats, after)
        table = after
