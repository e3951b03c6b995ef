import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import packing, search
from mnemospark.plans import requests as plans
from tests import brute

AS_OF = dt.datetime(2024, 2, 15)


def make(seed, n=120, queries=12):
    rng = np.random.default_rng(seed)
    memories = [
        {
            "id": i,
            "user_id": str(rng.choice(["a", "b"])),
            "project_id": rng.choice([None, "p"]),
            "content": "m" * int(rng.integers(1, 60)) + str(i),
            "memory_type": str(rng.choice(sorted(brute.TYPES))),
            "importance_score": float(rng.choice([0.0, 0.3, 0.9])),
            "decay_rate": 0.1,
            "access_count": int(rng.integers(0, 3)),
            "last_accessed": AS_OF - dt.timedelta(days=int(rng.integers(0, 30))),
            "embedding": [float(np.float32(x)) for x in rng.normal(size=5)],
        }
        for i in range(n)
    ]
    asked = [
        {
            "qid": q,
            "user_id": str(rng.choice(["a", "b", "nobody"])),
            "project_id": rng.choice([None, "p", ""]),
            "embedding": [float(np.float32(x)) for x in rng.normal(size=5)],
        }
        for q in range(queries)
    ]
    return memories, asked


def frames(spark, memories, asked):
    m = spark.createDataFrame(
        [tuple(r.values()) for r in memories],
        "id long, user_id string, project_id string, content string, memory_type string,"
        "importance_score double, decay_rate double, access_count int, last_accessed timestamp,"
        "embedding array<float>",
    )
    q = spark.createDataFrame(
        [tuple(r.values()) for r in asked],
        "qid long, user_id string, project_id string, embedding array<float>",
    )
    return m, q


def decayed(m):
    eff = max(0.0, m["decay_rate"] - math.log1p(m["access_count"]) * 0.1)
    days = (AS_OF - m["last_accessed"]).total_seconds() / 86400
    return max(0.0, min(1.0, m["importance_score"] * math.exp(-eff * days)))


def brute_search(request, memories, relevance, top_k):
    hits = brute.nearest(request, memories, 20)
    by_id = {m["id"]: m for m in memories}
    scores = [relevance.get((request["qid"], i)) for i, _ in hits]
    if all(s is None for s in scores):
        scores = [1 / len(hits) for _ in hits] if hits else []
    else:
        scores = [s or 0.0 for s in scores]
    rows = [
        ((r or s) * decayed(by_id[i]), -n, i, r, s)
        for n, ((i, s), r) in enumerate(zip(hits, scores))
    ]
    return sorted(rows, key=lambda r: (-r[0], -r[1]))[:top_k]


@pytest.fixture(scope="module")
def case(spark):
    memories, asked = make(11)
    rng = np.random.default_rng(5)
    relevance = {
        (q["qid"], m["id"]): float(rng.choice([0.0, 0.2, 0.7]))
        for q in asked
        for m in memories
        if q["qid"] % 4 and m["id"] % 6
    }
    table = spark.createDataFrame(
        [(*k, v) for k, v in relevance.items()], "qid long, id long, relevance double"
    )
    return memories, asked, relevance, *frames(spark, memories, asked), table


def test_search_equals_the_loop(case, as_of):
    memories, asked, relevance, m, q, table = case
    got = {}
    for r in search.search_memories(q, m, table, as_of).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r)
    for request in asked:
        want = brute_search(request, memories, relevance, 10)
        rows = got.get(request["qid"], [])
        assert [r.id for r in rows] == [w[2] for w in want]
        assert [r.score for r in rows] == pytest.approx([w[0] for w in want])


def test_rerank_function(case, as_of):
    *_, m, q, _ = case
    asked = q.withColumn("query", F.concat(F.lit("q"), F.col("qid")))

    def score(query: pd.Series, content: pd.Series) -> pd.Series:
        return content.str.len() / 100.0 + 0 * query.str.len()

    found = search.search_memories(asked, m, search.score_with(score), as_of, 20)
    for r in found.collect():
        assert r.rerank_score == pytest.approx(len(r.content) / 100.0)


def test_recall_and_similar(case, as_of):
    memories, asked, relevance, m, q, table = case
    by_id = {x["id"]: x["content"] for x in memories}
    told = {r.qid: r.contents for r in search.recall_project_context(q, m, table, as_of).collect()}
    wide = q.withColumn("top_k", F.when(F.col("qid") % 2 == 0, F.lit(7)))
    similar = {r.qid: r.contents for r in search.find_similar_problems(wide, m, table, as_of).collect()}
    for request in asked:
        ranked = brute_search(request, memories, relevance, 5)
        assert told.get(request["qid"], []) == [by_id[w[2]] for w in ranked]
        free = brute_search(
            dict(request, project_id=None), memories, relevance, 3 if request["qid"] % 2 else 7
        )
        assert similar.get(request["qid"], []) == [by_id[w[2]] for w in free]


def test_packing_skips_what_does_not_fit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for qid in range(30):
        for rank in range(1, int(rng.integers(1, 21)) + 1):
            rows.append(
                (qid, rank, 100 * qid + rank, float(rng.choice([0.0, 0.1, 0.5, 0.9])), "c" * int(rng.integers(0, 400)))
            )
    df = spark.createDataFrame(rows, "qid int, rank int, id int, score double, content string")
    results = df.withColumns(
        {
            "rerank_score": F.when(F.col("id") % 3 != 0, F.col("score")),
            "similarity": F.col("score"),
            "importance_score": F.lit(0.5),
            "memory_type": F.lit("general"),
        }
    )
    packed = packing.pack_memories(results, budget=100)
    got = {r.qid: r for r in packed.collect()}
    for qid in range(30):
        mine = [(r[1], r[2], r[3] * 0.5, r[4]) for r in rows if r[0] == qid]
        assert [s.id for s in got[qid].selected] == brute.pack(mine, 100)
        assert got[qid].tokens_used == sum(s.cost for s in got[qid].selected) <= 100


def test_context_text(spark, case, as_of):
    *_, m, q, table = case
    results, contexts = plans.retrieve_and_build(q, m, table, as_of, budget=30)
    rows = {r.qid: r for r in contexts.collect()}
    assert len(rows) == q.count()
    for row in rows.values():
        if row.n_used:
            first = row.memories_used[0]
            assert f"1. [{first.memory_type}] {first.content}" in row.context
            assert packing.SECTION_HEAD in row.context
        else:
            assert row.context == packing.OPENING + packing.CLOSING
    log = plans.recall_log(results, as_of)
    assert log.count() == results.filter("rank <= 5").count()


def test_oversize(spark):
    df = spark.createDataFrame([(1, "u", "x" * 43), (2, "u", "x" * 44)], "id int, user_id string, content string")
    assert [r.id for r in packing.oversize_memories(df, budget=10).collect()] == [2]


def test_every_rerank_call_has_its_own_status(spark):
    memories, asked = make(31, queries=10)
    for k, request in enumerate(asked):
        request["user_id"] = "a" if k < 9 else "nobody"
    m, q = frames(spark, memories, asked)
    calls = spark.sparkContext.accumulator(0)

    def call(query, contents):
        calls.add(1)
        if query == "q0":
            raise TimeoutError
        answers = {"q1": None, "q2": [(len(contents), 1.0)], "q3": [(0, "high")], "q4": 7, "q5": [], "q6": [(0.5, 1.0)]}
        return answers.get(query, [(n, len(c) / 100) for n, c in enumerate(contents) if len(c) % 2])

    when = F.lit(str(AS_OF)).cast("timestamp")
    found = search.search_memories(
        q.withColumn("query", F.concat(F.lit("q"), "qid")), m, search.call_per_request(call), when, 20
    ).collect()
    assert calls.value == 9
    for request in asked[:9]:
        rows = [r for r in found if r.qid == request["qid"]]
        if request["qid"] in (0, 1, 2, 3, 4, 6):
            assert {r.rerank_score for r in rows} == {1 / len(rows)}
        elif request["qid"] == 5:
            assert {r.rerank_score for r in rows} == {0.0}
            assert [r.score for r in rows] == [r.similarity * r.importance_score for r in rows]
        else:
            assert all(r.rerank_score == pytest.approx(len(r.content) / 100 if len(r.content) % 2 else 0.0) for r in rows)
    assert not [r for r in found if r.qid == asked[9]["qid"]]
