"""Tool calls as one batch against the same calls one after another."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import lifecycle, tools
from mnemospark.schema import DECAY_RATES
from tests import brute

AS_OF = dt.datetime(2024, 2, 15)
OLD = dt.datetime(2024, 1, 20)
MEMORY = (
    "id long, user_id string, project_id string, content string, memory_type string, importance_score double,"
    "decay_rate double, access_count int, created_at timestamp, last_accessed timestamp, embedding array<float>"
)


def make(seed, n_calls):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 6))

    def vector():
        return [float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(size=6) * 0.25]

    stored = [
        {
            "id": k, "user_id": str(rng.choice(["u", "v"])), "project_id": rng.choice([None, "p"]), "content": f"stored {k}",
            "memory_type": "general", "importance_score": float(rng.choice([0.0, 0.15, 0.6])), "decay_rate": 0.1,
            "access_count": int(rng.integers(0, 2)), "created_at": OLD, "last_accessed": OLD, "embedding": vector(),
        }
        for k in range(20)
    ]
    calls, vectors = [], {}
    for n in range(n_calls):
        tool = str(rng.choice([tools.SAVE, tools.SAVE, tools.SAVE, tools.RECALL, tools.SIMILAR, tools.HEALTH]))
        args = {
            tools.SAVE: {"insight": f"made {n}", "memory_type": str(rng.choice(["decision", "pattern"])), "importance": float(rng.choice([0.0, 0.1, 0.9]))},
            tools.RECALL: {"current_task": f"task {n}"},
            tools.SIMILAR: {"problem_description": f"problem {n}", "top_k": [2, None, -3][n % 3]},
            tools.HEALTH: {},
        }[tool]
        calls.append((n, str(rng.choice(["u", "u", "v", "new"])), rng.choice([None, "p"]), tool, json.dumps(args)))
        if n % 17 != 5:
            vectors[n] = vector()
    return stored, calls, vectors


def decayed(m):
    rate = max(0.0, m["decay_rate"] - math.log1p(m["access_count"]) * 0.1)
    return max(0.0, min(1.0, m["importance_score"] * math.exp(-rate * (AS_OF - m["last_accessed"]).total_seconds() / 86400)))


def one_after_another(stored, calls, vectors):
    table, answers = [dict(m) for m in stored], {}
    for n, user, project, tool, args in calls:
        args = json.loads(args)
        mine = [m for m in table if m["user_id"] == user]
        if tool == tools.HEALTH:
            types = {t: sum(m["memory_type"] == t for m in mine) for t in {m["memory_type"] for m in mine}}
            scores = [m["importance_score"] for m in mine]
            answers[n] = (len(mine), sum(scores), sum(s < 0.2 for s in scores), types, max([m["created_at"] for m in mine], default=None))
            continue
        if n not in vectors:
            answers[n] = "error"
            continue
        request = {"user_id": user, "project_id": None if tool == tools.SIMILAR else project, "embedding": vectors[n]}
        by_id = {m["id"]: m for m in table}
        if tool == tools.SAVE:
            hit = brute.nearest(request, table, 1, 0.93)
            # Among equally near rows the stored ones come first, then the order of the calls.
            if hit:
                best = min((m for m in table if m["importance_score"] > 0 and brute.visible(request, m) and brute.cosine(vectors[n], m["embedding"]) == hit[0][1]), key=lambda m: (m["id"] < 0, abs(m["id"])))
                best["importance_score"] = min(1.0, best["importance_score"] + 0.2)
                best["access_count"] += 1
                best["last_accessed"] = AS_OF
                answers[n] = ("reinforce", best["id"])
            else:
                table.append(dict(id=-(n + 1), user_id=user, project_id=project, content=args["insight"], memory_type=args["memory_type"],
                                  importance_score=args["importance"], decay_rate=DECAY_RATES[args["memory_type"]], access_count=0,
                                  created_at=AS_OF, last_accessed=AS_OF, embedding=vectors[n]))
                answers[n] = ("insert", -(n + 1))
            continue
        hits = brute.nearest(request, table, 20)
        ranked = sorted(enumerate(hits), key=lambda h: (-decayed(by_id[h[1][0]]) / len(hits), h[0]))
        texts = [by_id[i]["content"] for _, (i, _) in ranked]
        if tool == tools.RECALL:
            answers[n] = texts[:5]
        else:
            answers[n] = texts[: args["top_k"]]
    return table, answers


def run(spark, stored, calls, vectors, users=None, as_of=None, **options):
    m = spark.createDataFrame([tuple(r.values()) for r in stored], MEMORY)
    c = spark.createDataFrame(calls, "request_id long, user_id string, project_id string, name string, args string").repartition(3)
    v = spark.createDataFrame(list(vectors.items()), "request_id long, embedding array<float>")
    return tools.run_tool_calls_table(c, v, m, users, None, as_of, new_id=-(F.col("seq") + 1), **options)


@pytest.mark.parametrize("seed,options", [(3, {}), (4, {"broadcast_requests": 0, "local_rows": 8})])
def test_calls_see_what_earlier_calls_did(spark, as_of, seed, options):
    if options:
        options = {"broadcast_requests": 0}
    stored, calls, vectors = make(seed, 90)
    known = spark.createDataFrame([("u", OLD, OLD), ("v", OLD, OLD)], "user_id string, created_at timestamp, updated_at timestamp")
    done = run(spark, stored, calls, vectors, known, as_of, **options)
    table, answers = one_after_another(stored, calls, vectors)
    assert {a[0] for a in answers.values() if isinstance(a, tuple)} >= {"insert", "reinforce"}
    results = {r.request_id: json.loads(r.result) for r in done.results.collect()}
    assert set(results) == set(answers)
    for n, _, _, tool, _ in calls:
        got, want = results[n], answers[n]
        if want == "error":
            assert got == {"error": "no embedding of the text"}
        elif tool == tools.SAVE:
            assert (got["action"], got["memory_id"]) == want and got["saved"] is True
        elif tool == tools.RECALL:
            assert got["memories"] == want
        elif tool == tools.SIMILAR:
            assert got["similar_problems"] == want
        else:
            total, held, risky, types, newest = want
            assert (got["total_memories"], got["memories_at_risk"]) == (total, risky)
            assert got.get("memories_by_type", {}) == types
            assert got.get("avg_importance", 0.0) * total == pytest.approx(held)
            assert ("newest_memory" in got) == (newest is not None)
            if newest is not None:
                assert got["newest_memory"].startswith(newest.strftime("%Y-%m-%d"))
    rows = {r.id: r for r in done.memories.collect()}
    assert set(rows) == {m["id"] for m in table}
    for m in table:
        row = rows[m["id"]]
        assert row.importance_score == pytest.approx(m["importance_score"]) and row.access_count == m["access_count"]
        assert row.last_accessed == m["last_accessed"]
    makers = {c[1] for c in calls if answers[c[0]] == ("insert", -(c[0] + 1))}
    assert {r.user_id for r in done.users.collect()} == {"u", "v"} | makers


def test_arguments_that_cannot_run(spark):
    def parsed(name, args):
        frame = spark.createDataFrame([(1, "u", "home", name, args)], "request_id int, user_id string, project_id string, name string, args string")
        return tools.parse_tool_calls(frame).first()

    limits = {"null": 20, "4": 4, "-2": -2, "0": 0, "true": 1, "900": 20}
    for given, want in limits.items():
        row = parsed(tools.SIMILAR, f'{{"problem_description":"d","top_k":{given}}}')
        assert (row.top_k, row.error) == (want, None)
    for given in ('"many"', "2.5", "[1]", '"3"'):
        assert parsed(tools.SIMILAR, f'{{"problem_description":"d","top_k":{given}}}').error == "invalid top_k"
    for insight in ("5", "null", "[]", '""'):
        assert parsed(tools.SAVE, f'{{"insight":{insight},"memory_type":"pattern"}}').error == "invalid content"
    assert parsed(tools.SAVE, '{"insight":"5","memory_type":"pattern"}').error is None


def test_users_of_inserts_are_added(spark, as_of):
    stored, _, vectors = make(5, 4)
    calls = [(0, "fresh", None, tools.SAVE, '{"insight":"i","memory_type":"pattern"}')]
    done = run(spark, stored, calls, {0: vectors[0]}, spark.createDataFrame([], "user_id string, created_at timestamp, updated_at timestamp"), as_of)
    assert [r.user_id for r in done.users.collect()] == ["fresh"]
    assert lifecycle.upsert_users(done.users, done.memories, as_of).count() == len({m["user_id"] for m in stored}) + 1


@pytest.mark.parametrize("reads_texts", [False, True])
def test_candidates_are_stored_without_texts(spark, as_of, monkeypatch, reads_texts):
    """Texts are joined to what is told and to what a reranker reads; repeated ids and null texts stay as they are."""
    stored, calls, vectors = make(3, 0)
    twins = [{**stored[0], "id": 1, "user_id": "u", "importance_score": 0.9, "content": c, "embedding": [1.0] * 6} for c in ("a", "b")]
    other = {**twins[0], "id": 2, "content": None, "embedding": [1.0, 1.0, 1.0, 1.0, 1.0, 0.0]}
    args = json.dumps({"problem_description": "which", "top_k": None})
    kept = []
    written = tools.materialised
    monkeypatch.setattr(tools, "materialised", lambda df: kept.append(df.columns) or written(df))

    def rerank(candidates):
        return candidates.withColumn("relevance", F.coalesce(F.length("content") + F.length("query"), F.lit(1)) / 10.0)

    m = spark.createDataFrame([tuple(r.values()) for r in [*twins, other]], MEMORY)
    c = spark.createDataFrame([(5, "u", None, tools.SIMILAR, args)], "request_id long, user_id string, project_id string, name string, args string")
    v = spark.createDataFrame([(5, [1.0] * 6)], "request_id long, embedding array<float>")
    done = tools.run_tool_calls_table(c, v, m, None, rerank if reads_texts else None, as_of, new_id=-(F.col("seq") + 1))
    told = json.loads(done.results.first()["result"], object_hook=dict)["similar_problems"]
    assert sorted(x for x in told if x is not None) == ["a", "a", "b", "b"]
    candidates = [names for names in kept if "candidate_rank" in names]
    assert candidates and not any({"content", "query"} & set(names) for names in candidates)
