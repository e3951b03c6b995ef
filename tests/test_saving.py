import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import saving
from mnemospark.sources import samples
from tests import brute

MEMORY = (
    "id long, user_id string, project_id string, content string, memory_type string,"
    "importance_score double, decay_rate double, access_count int, created_at timestamp,"
    "last_accessed timestamp, embedding array<float>"
)
INCOMING = (
    "seq long, user_id string, project_id string, content string, memory_type string,"
    "importance_score double, embedding array<double>"
)


def make(seed, n_stored, n_incoming, spread, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))

    def row(key, n):
        v = centres[rng.integers(12)] + rng.normal(size=8) * spread
        return {
            key: n,
            "user_id": str(rng.choice(["big", "big", "b"])),
            "project_id": rng.choice([None, "p", "q"]),
            "importance_score": float(rng.choice([0.0, 0.5, 0.9])),
            "embedding": [float(np.float32(x)) for x in v],
        }

    stored = [row("id", i) for i in range(n_stored)]
    incoming = [row("seq", i) for i in range(n_incoming)]
    for i in range(copies):  # one text saved over and over by the same user
        incoming.append(dict(incoming[0], seq=n_incoming + i, importance_score=0.5))
    return stored, incoming


def frames(spark, stored, incoming):
    import datetime as dt

    then = dt.datetime(2024, 1, 1)
    m = [
        (r["id"], r["user_id"], r["project_id"], "m", "general", r["importance_score"], 0.1, 0, then, then, r["embedding"])
        for r in stored
    ]
    i = [
        (r["seq"], r["user_id"], r["project_id"], "n", "decision", r["importance_score"], r["embedding"])
        for r in incoming
    ]
    return spark.createDataFrame(m, MEMORY), spark.createDataFrame(i, INCOMING).repartition(4)


@pytest.mark.parametrize("seed,spread,copies", [(1, 0.3, 0), (2, 0.5, 40)])
def test_in_order_equals_the_loop(spark, seed, spread, copies):
    stored, incoming = make(seed, 15, 90, spread, copies)
    m, i = frames(spark, stored, incoming)
    want = brute.save_in_order(stored, incoming)
    for options in ({}, {"local_rows": 20, "broadcast_requests": 0}):
        got = {
            r.seq: (r.target, r.id if r.target == "stored" else r.target_seq)
            for r in saving.decide_in_order(m, i, **options).collect()
        }
        assert got == want


def test_snapshot_sees_only_the_stored_rows(spark):
    stored, incoming = make(4, 20, 60, 0.3)
    m, i = frames(spark, stored, incoming)
    for r in saving.decide_snapshot(m, i).collect():
        request = next(x for x in incoming if x["seq"] == r.seq)
        hit = brute.nearest(request, stored, 1, 0.93)
        assert (r.action, r.id) == (("reinforce", hit[0][0]) if hit else ("insert", None))


def test_next_table(spark, as_of):
    stored, incoming = make(5, 20, 60, 0.3, copies=10)
    m, i = frames(spark, stored, incoming)
    table, decisions = saving.save_in_order(m, i, as_of, new_id=-(F.col("seq") + 1))
    rows = {r.id: r for r in table.collect()}
    want = brute.save_in_order(stored, incoming)
    inserted = [s for s, (target, _) in want.items() if target is None]
    assert len(rows) == len(stored) + len(inserted)
    for memory in stored:
        n = sum(v == ("stored", memory["id"]) for v in want.values())
        row = rows[memory["id"]]
        assert row.access_count == n
        assert row.importance_score == pytest.approx(min(1.0, memory["importance_score"] + 0.2 * n))
    for seq in inserted:
        n = sum(v == ("batch", seq) for v in want.values())
        score = next(x for x in incoming if x["seq"] == seq)["importance_score"]
        assert rows[-(seq + 1)].access_count == n
        assert rows[-(seq + 1)].decay_rate == 0.05
        expected = min(1.0, score + 0.2 * n) if n else score
        assert rows[-(seq + 1)].importance_score == pytest.approx(expected)
    assert decisions.count() == len(incoming)


def test_derived_ids_repeat(spark, as_of):
    stored, incoming = make(6, 2, 10, 2.0)
    m, i = frames(spark, stored, incoming)
    m = m.withColumn("id", F.col("id").cast("string"))
    once, _ = saving.save_snapshot(m, i, as_of)
    again, _ = saving.save_snapshot(m, i, as_of)
    ids = {r.id for r in once.select("id").collect()}
    assert ids == {r.id for r in again.select("id").collect()} and len(ids) == once.count()


def test_a_save_without_a_vector_fails_alone(spark, as_of):
    folder = "/root/testdata/sf0.001"
    memories, incoming = samples.vector_memories(spark, folder), samples.incoming_memories(spark, folder)
    broken = incoming.withColumn("embedding", F.when(F.col("seq") % 3 == 0, None).otherwise(F.col("embedding")))
    lost = broken.filter("embedding is null").count()
    for decide in (saving.decide_snapshot, saving.decide_in_order):
        got = decide(memories, broken)
        assert got.filter("action = 'failed'").count() == lost > 0
        assert got.filter("action = 'failed' and seq % 3 <> 0").isEmpty() and got.count() == incoming.count()


def test_a_drifting_chain_takes_few_rounds(spark, monkeypatch):
    """Every row is near the one before only; each round settles as many rows as a task may hold."""
    import math

    local, n = 12, 60
    angle = math.acos(0.94)
    rows = [
        {"seq": k, "user_id": "u", "project_id": None, "importance_score": 0.5, "embedding": [math.cos(k * angle / 1.0), math.sin(k * angle / 1.0)]}
        for k in range(n)
    ]
    rounds = []
    first = saving._first_rows
    monkeypatch.setattr(saving, "_first_rows", lambda *a: rounds.append(1) or first(*a))
    m, i = frames(spark, [], rows)
    want = brute.save_in_order([], rows)
    got = {r.seq: (r.target, r.target_seq) for r in saving.decide_in_order(m, i, local_rows=local).collect()}
    assert got == want
    assert 0 < len(rounds) <= n // local + 2
