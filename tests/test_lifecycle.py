import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import lifecycle, reports, vectors
from mnemospark.operators.ranking import top_k_per_group
from mnemospark.plans import maintenance

OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 14)
SCHEMA = (
    "id string, user_id string, project_id string, content string, memory_type string,"
    "importance_score double, decay_rate double, access_count int, created_at timestamp,"
    "last_accessed timestamp"
)


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame(
        [
            ("a", "u", "p", "one", "general", 0.9, 0.1, 0, OLD, NEW),
            ("b", "u", "q", "two", "decision", 0.1, 0.1, 0, OLD, OLD),
            ("c", "u", None, "three", "general", 0.5, 0.02, 5, OLD, OLD),
            ("d", "v", "p", "four", "pattern", 0.95, 0.03, 0, NEW, OLD),
        ],
        SCHEMA,
    )


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_reinforce_counts_and_caps(spark, memories):
    log = spark.createDataFrame(
        [("a", OLD), ("b", NEW), ("b", OLD), ("zzz", NEW)], "memory_id string, ts timestamp"
    )
    rows = by_id(lifecycle.reinforce(memories, log))
    assert rows["a"].importance_score == 1.0 and rows["a"].last_accessed == NEW
    assert rows["b"].importance_score == pytest.approx(0.5) and rows["b"].access_count == 2
    assert rows["b"].last_accessed == NEW and rows["c"].access_count == 5
    assert set(rows) == set("abcd")
    touched = by_id(lifecycle.touch_access(memories, log))
    assert touched["b"].importance_score == 0.1 and touched["b"].access_count == 2


def test_two_single_recalls_equal_one_double(spark, memories):
    one = spark.createDataFrame([("b", NEW)], "memory_id string, ts timestamp")
    twice = lifecycle.reinforce(lifecycle.reinforce(memories, one), one)
    double = lifecycle.reinforce(memories, one.unionByName(one))
    a, b = by_id(twice), by_id(double)
    for key in a:
        assert a[key].importance_score == pytest.approx(b[key].importance_score)
        assert a[key].access_count == b[key].access_count


def test_sweep(memories, as_of):
    planned = lifecycle.plan_sweep(memories, as_of)
    assert {r.id: r.action for r in planned.collect()} == {
        "a": "update", "b": "forget", "c": "keep", "d": "update",
    }
    assert {r.user_id: r.memories_forgotten for r in lifecycle.forgotten_per_user(planned).collect()} == {"u": 1, "v": 0}
    assert set(by_id(lifecycle.sweep(memories, as_of))) == {"a", "c", "d"}
    plan = planned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sweep_at_the_access_time_changes_nothing(memories):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    still = memories.withColumn("last_accessed", now)
    assert {r.action for r in lifecycle.plan_sweep(still, now).collect()} == {"keep"}


def test_repeated_sweeps(memories, as_of):
    once, twice = memories, memories
    once = lifecycle.sweep(once, as_of)
    twice = lifecycle.sweep(once, as_of)
    assert by_id(twice)["d"].importance_score < by_id(once)["d"].importance_score
    first = lifecycle.sweep(memories, as_of, rebase=True)
    second = lifecycle.sweep(first, as_of, rebase=True)
    assert by_id(second)["d"].importance_score == pytest.approx(by_id(first)["d"].importance_score)


def test_capped_sweep_leaves_the_weakest(memories, as_of):
    planned = lifecycle.plan_sweep(memories, as_of, cap=2)
    assert {r.id: r.action for r in planned.collect()}["b"] == "keep"
    assert {r.id: r.action for r in lifecycle.plan_sweep(memories, as_of, cap=3).collect()}["b"] == "forget"


def test_users_and_deletes(spark, memories, as_of):
    users = spark.createDataFrame([("u", OLD, OLD)], "user_id string, created_at timestamp, updated_at timestamp")
    more = lifecycle.upsert_users(users, memories, as_of)
    rows = {r.user_id: r.created_at for r in more.collect()}
    assert set(rows) == {"u", "v"} and rows["u"] == OLD
    gone = spark.createDataFrame([("a", "v"), ("d", "v"), ("nope", "v")], "id string, user_id string")
    assert set(by_id(lifecycle.delete_by_id(memories, gone))) == {"b", "c"}
    assert set(by_id(lifecycle.delete_by_id(memories, gone, check_owner=True))) == {"a", "b", "c"}
    left_users, left = lifecycle.delete_users(more, memories, gone)
    assert {r.user_id for r in left_users.collect()} == {"u"} and set(by_id(left)) == {"a", "b", "c"}
    scored = spark.createDataFrame([("a", 0.25)], "id string, new_score double")
    assert by_id(lifecycle.set_importance(memories, scored))["a"].importance_score == 0.25


def test_forget_commands(spark, memories, as_of):
    commands = spark.createDataFrame(
        [(1, "u", "a", True), (2, "u", None, True), (3, "v", "", False), (4, "v", None, None)],
        "command_id int, user_id string, memory_id string, run_decay boolean",
    )
    table, outcome = lifecycle.forget(memories, commands, as_of)
    rows = {r.command_id: r for r in outcome.collect()}
    assert rows[1].kind == "delete" and rows[1].memory_id == "a"
    assert rows[2].forgotten_count == 1 and rows[3].kind == rows[4].kind == "error"
    left = by_id(table)
    assert set(left) == {"c", "d"} and left["d"].importance_score == 0.95


def loop_of_commands(rows, commands, as_of):
    """Forget commands one after another; rows: id -> (user, score, rate, accesses, last access)."""
    import math

    table, outcome = {i: list(r) for i, r in rows.items()}, {}
    for number, user, memory_id, run_decay in sorted(commands):
        if memory_id:
            table.pop(memory_id, None)
        elif run_decay:
            fell = 0
            for i, (owner, score, rate, n, last) in list(table.items()):
                if owner != user:
                    continue
                days = (as_of - last).total_seconds() / 86400
                after = max(0.0, min(1.0, score * math.exp(-max(0.0, rate - math.log1p(n) * 0.1) * days)))
                if after < 0.05:
                    del table[i]
                    fell += 1
                elif abs(after - score) > 0.001:
                    table[i][1] = after
            outcome[number] = fell
    return {i: r[1] for i, r in table.items()}, outcome


def test_sweeps_compound_between_deletions(spark, as_of):
    import datetime as dt
    import random

    rng = random.Random(4)
    now = dt.datetime(2024, 2, 15)
    rows = {
        f"m{k}": (f"u{k % 3}", rng.random(), rng.choice([0.02, 0.05, 0.1]), rng.randrange(3), now - dt.timedelta(days=rng.randrange(-3, 30)))
        for k in range(120)
    }
    commands = [
        (n, f"u{rng.randrange(4)}", f"m{rng.randrange(130)}" if n % 3 == 0 else None, n % 3 == 1) for n in range(40)
    ]
    memories = spark.createDataFrame(
        [(i, *r) for i, r in rows.items()],
        "id string, user_id string, importance_score double, decay_rate double, access_count int, last_accessed timestamp",
    )
    asked = spark.createDataFrame(commands, "command_id int, user_id string, memory_id string, run_decay boolean")
    table, outcome = lifecycle.forget(memories, asked, as_of)
    want, fell = loop_of_commands(rows, commands, now)
    got = {r.id: r.importance_score for r in table.collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    told = {r.command_id: r.forgotten_count for r in outcome.filter("kind = 'decay'").collect()}
    assert told == fell and len(set(told.values())) > 2


def test_many_sweeps_end_in_a_fixed_point(spark, memories, as_of):
    walked = memories.select("id", lifecycle.swept_times(as_of, F.lit(5_000)).alias("w"), lifecycle.swept_times(as_of, F.lit(1_001)).alias("v"))
    assert all(r.w == r.v for r in walked.collect())


def test_stats(spark, memories):
    users = spark.createDataFrame([("u",), ("empty",)], "user_id string")
    rows = {r.user_id: r for r in reports.memory_stats(memories, users).collect()}
    assert rows["u"].total_memories == 3 and rows["u"].memories_at_risk == 1
    assert rows["u"].avg_importance == pytest.approx(0.5)
    assert rows["empty"].total_memories == 0 and rows["empty"].avg_importance is None
    full = {r.user_id: r for r in reports.full_stats(memories).collect()}
    assert full["u"].memories_by_type == {"general": 2, "decision": 1}
    asked = spark.createDataFrame(
        [(1, "u", None), (2, "u", ""), (3, "u", "p"), (4, "u", "none"), (5, "x", None)],
        "qid int, user_id string, project_id string",
    )
    got = {r.qid: r.total_memories for r in reports.memory_stats_project(memories, asked).collect()}
    assert got == {1: 3, 2: 3, 3: 1, 4: 0, 5: 0}
    health = {r.qid: r for r in reports.memory_health(asked, memories).collect()}
    assert health[3].total_memories == 3 and health[5].total_memories == 0
    counts = {r.id: r.cnt for r in reports.with_type_count(memories).collect()}
    assert counts == {"a": 2, "b": 1, "c": 2, "d": 1}


def test_panel_and_maintenance(memories, as_of):
    panel = maintenance.user_panel(memories, as_of, "u", "p")
    assert [r.id for r in panel.listing.collect()] == ["a"]
    assert panel.chart.first().label == "one" and panel.stats.first().total_memories == 1
    day = maintenance.daily_maintenance(memories, as_of)
    assert day.memories.count() == 3
    report = {r.user_id: r for r in day.report.collect()}
    assert (report["u"].total_memories, report["u"].memories_forgotten) == (2, 1)
    assert report["u"].memories_by_type == {"general": 2}
    assert report["v"].avg_importance == pytest.approx(day.memories.filter("id = 'd'").first().importance_score)


def test_list_of_any_length(memories):
    assert reports.list_by_user(memories, limit=500).count() == memories.count()


def test_top_k_of_one_huge_group(spark):
    df = spark.range(5000).select(F.lit("u").alias("user"), F.col("id"), (F.col("id") % 97).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    split = top_k_per_group(df.repartition(8), ["user"], order, 50, split_on="id")
    whole = top_k_per_group(df, ["user"], order, 50, split_on=None)
    assert [tuple(r) for r in split.orderBy("rank").collect()] == [tuple(r) for r in whole.orderBy("rank").collect()]


def test_failing_texts_are_reported_and_known_ones_not_embedded(spark):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)
    texts = ["known", "good", "good", "bad", "empty", "odd", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    store = spark.createDataFrame([("known", [9.0])], "t string, embedding array<float>").select(
        vectors.text_key("t").alias("text_key"), "embedding"
    )

    def embed(batch: pd.Series) -> pd.Series:
        seen.add(int((batch == "good").sum()))
        if (batch == "bad").any():
            raise RuntimeError("refused")
        return batch.map({"good": [1.0, 2.0], "empty": [], "odd": ["x"], "known": [0.0]})

    done = vectors.embed_missing(rows, store, embed)
    assert {(r.id, r.reason) for r in done.failed.collect()} == {(3, "RuntimeError: refused"), (4, "no vector"), (5, "no vector")}
    attached = {r.id: r.embedding for r in vectors.attach_embeddings(rows, done.store).collect()}
    assert attached == {0: [9.0], 1: [1.0, 2.0], 2: [1.0, 2.0], 3: None, 4: None, 5: None, 6: None}
    assert done.vectors.count() == 1 and seen.value == 2  # in the batch, then alone
    again = vectors.embed_missing(rows, done.store, embed)
    assert again.vectors.count() == 0 and seen.value == 2


def test_embedding_function_sees_each_text_once(spark):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "id int, content string")

    def embed(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t)), float(t[-1])])

    attached = vectors.attach_embeddings(rows, vectors.embed_distinct(rows, embed))
    got = {r.id: list(r.embedding) for r in attached.collect()}
    assert got[4] == [6.0, 1.0] and len(got) == 30 and seen.value == 3
