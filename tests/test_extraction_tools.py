import json

from pyspark.sql import functions as F

from mnemospark.operators import extraction, tools
from tests import brute

GOOD = '{"content":"fact","memory_type":"decision","importance_score":0.9}'
RAW = [
    f"[{GOOD}]", f"```json\n[{GOOD}]\n```", f"```\n[{GOOD}]\n``` and more", f"  [{GOOD}]\n",
    "[]", "not json", '{"content":"fact"}', "", "```", "[1", f"[{GOOD}] tail", f"[{GOOD}],[{GOOD}]",
    f'[{GOOD}],"x"],[', "null", "17", '"text"', "true",
    "[" + ",".join(['{"content":"a"}'] * 2 + ['{"content":"b","memory_type":"other"}'] + ['{"content":"c"}'] * 4) + "]",
    '[{"content":"x","importance_score":1.7},{"content":"y"}]',
    '[{"memory_type":"general"},{"content":""},{"content":"ok"}]',
    f"[{GOOD}, 5]", f"[5, {GOOD}]", f"[{GOOD}, null]", f'[{GOOD}, ["a"]]', f'[{GOOD}, "text"]',
    '[{"content":"only"}]', f'[{GOOD},{{"content":"n","importance_score":null}}]',
    f'[{GOOD},{{"content":"n","importance_score":"abc"}}]', '[{"content":"n","importance_score":"0.4"}]',
    '[{"content":"n","importance_score":" 4e-1 "}]', '[{"content":"n","importance_score":"0.5d"}]',
    '[{"content":"n","importance_score":""}]', '[{"content":"n","importance_score":"."}]',
    '[{"content":"n","importance_score":"1_0e-1_0"}]', '[{"content":"n","importance_score":true}]',
    '[{"content":"n","importance_score":false}]', '[{"content":"n","importance_score":[1]}]',
    '[{"content":"n","importance_score":{"a":1}}]', '[{"content":"n","importance_score":-0.1}]',
    '[{"content":"n","importance_score":1}]', '[{"content":"n","importance_score":0}]',
    f'[{GOOD},{{"content":"n","memory_type":null}}]', '[{"content":"n","memory_type":3},{"content":"m"}]',
    '[{"memory_type":"bad","content":"n","importance_score":null},{"content":"m"}]',
    '[{"importance_score":null},{"content":"m"}]', '[{"content":null}]', '[{"content":5},{"content":true}]',
    '[{"content":"a \\"q\\" \\u00e9 \\n b"}]', '[{"content":"dup","content":"last"}]',
    '[{"content":"x","importance_score":1e400}]', f"json[{GOOD}]", f"```json[{GOOD}]```",
    f"```JSON[{GOOD}]```", '[{"content":"e","extra":{"deep":[1,2]}}]', "[[]]", "[{}]", " []",
]


def test_completions_equal_the_loop(spark):
    df = spark.createDataFrame(list(enumerate(RAW)), "completion_id int, raw string")
    got = {}
    for r in extraction.parse_completions(df).orderBy("completion_id", "item_no").collect():
        got.setdefault(r.completion_id, []).append(
            (r.item_no, r.content, r.memory_type, r.importance_score)
        )
    for i, raw in enumerate(RAW):
        assert got.get(i, []) == brute.completion(raw), raw


def test_null_content_can_be_refused(spark):
    df = spark.createDataFrame([(1, '[{"content":null},{"content":"ok"}]')], "completion_id int, raw string")
    assert [r.content for r in extraction.parse_completions(df, null_content=None).collect()] == ["ok"]


def test_parsing_is_a_map(spark):
    df = spark.createDataFrame(list(enumerate(RAW)), "completion_id int, raw string")
    plan = extraction.parse_completions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rejected_items_name_the_reason(spark):
    df = spark.createDataFrame([(1, '[{"content":""},{"content":"x","memory_type":"y"}, 3]')], "completion_id int, raw string")
    rows = {r.item_no: r for r in extraction.rejected_items(df).collect()}
    assert rows[0].rejected_because == "content" and rows[1].rejected_because == "memory_type"
    assert rows[2].fatal and not rows[0].fatal


def test_rendering_and_requests(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "yes"), (1, 0, "user", "hello"), (2, 0, "system", "s")],
        "conv_id int, turn int, role string, text string",
    )
    rows = {r.conv_id: r for r in extraction.render_conversations(turns).collect()}
    assert rows[1].conversation == "USER: hello\nASSISTANT: yes" and rows[1].n_turns == 2
    parts = extraction.render_conversations(turns, part_turns=1).filter("conv_id = 1")
    assert [r.conversation for r in parts.orderBy("part").collect()] == ["USER: hello", "ASSISTANT: yes"]
    numbers = [(3, k, "user", f"line {k}") for k in range(600)] + [(4, 5000 * k, "user", f"line {k}") for k in range(40)]
    long = spark.createDataFrame(numbers, turns.schema)
    whole = {r.conv_id: r.conversation for r in extraction.render_conversations(long).collect()}
    assert whole == {3: "\n".join(f"USER: line {k}" for k in range(600)), 4: "\n".join(f"USER: line {k}" for k in range(40))}
    assert extraction.extraction_requests(long, per="conversation").count() == 2
    asked = extraction.extraction_requests(turns).collect()
    assert [(r.conv_id, r.turn) for r in asked] == [(1, 0)]
    assert asked[0].prompt.endswith("USER: hello")
    whole = {r.conv_id: r.prompt for r in extraction.extraction_requests(turns, per="conversation").collect()}
    assert whole[1].endswith(rows[1].conversation)
    assert extraction.extraction_requests(turns.limit(0), per="conversation").isEmpty()


CALLS = [
    (1, "u", "home", "recall_project_context", '{"current_task":"t"}'),
    (2, "u", "home", "recall_project_context", '{"current_task":"t","project_id":"other"}'),
    (3, "u", "home", "recall_project_context", '{"current_task":"t","project_id":null}'),
    (4, "u", "home", "recall_project_context", '{"project_id":"p"}'),
    (5, "u", "home", "save_developer_insight", '{"insight":"i","memory_type":"pattern"}'),
    (6, "u", "home", "save_developer_insight", '{"insight":"i","memory_type":"general","importance":0.05}'),
    (7, "u", "home", "save_developer_insight", '{"insight":"","memory_type":"pattern"}'),
    (8, "u", "home", "save_developer_insight", '{"insight":"i","memory_type":"odd"}'),
    (9, "u", "home", "find_similar_problems", '{"problem_description":"d"}'),
    (10, "u", "home", "find_similar_problems", '{"problem_description":"d","top_k":9}'),
    (11, "u", "home", "get_memory_health", '{"user_id":"someone else"}'),
    (12, "u", "home", "format_disk", "{}"),
    (13, "u", "home", "get_memory_health", '{"user_id":'),
    (14, "u", "home", "get_memory_health", "[]"),
]


def calls(spark):
    return spark.createDataFrame(CALLS, "request_id int, user_id string, project_id string, name string, args string")


def test_tool_calls(spark):
    rows = {r.request_id: r for r in tools.parse_tool_calls(calls(spark)).collect()}
    assert [rows[i].project_id for i in (1, 2, 3, 9)] == ["home", "other", None, None]
    assert [rows[i].error is None for i in range(1, 15)] == [
        True, True, True, False, True, True, False, False, True, True, True, False, False, False,
    ]
    assert rows[5].importance_score == 0.7 and rows[6].importance_score == 0.05
    assert rows[9].top_k == 3 and rows[10].top_k == 9 and rows[11].user_id == "u"
    assert rows[12].error == "no such tool: format_disk"


def test_declared_arguments(spark):
    rows = {r.request_id: r.as_declared for r in tools.check_declared_args(calls(spark)).collect()}
    assert {i for i, ok in rows.items() if ok} == {2, 3, 5, 7, 9, 10, 11}


def test_running_tool_calls(spark, as_of):
    from tests.test_search_packing import frames, make

    memories, _ = make(21)
    for m in memories:
        m["user_id"] = "u"
        m["project_id"] = "home" if m["id"] % 2 else "other"
    m, _ = frames(spark, memories, [{"qid": 0, "user_id": "u", "project_id": None, "embedding": [1.0] * 5}])
    m = m.withColumn("created_at", F.col("last_accessed"))
    vectors = spark.createDataFrame(
        [(r[0], [1.0, 0.0, 0.5, 0.0, float(r[0])]) for r in CALLS], "request_id int, embedding array<float>"
    )
    rows = {r.request_id: (r.tool, json.loads(r.result)) for r in tools.run_tool_calls(calls(spark), vectors, m, None, as_of, new_id=-(F.col("seq") + 1)).collect()}
    assert set(rows) == {c[0] for c in CALLS}
    assert len(rows[1][1]["memories"]) == 5 and len(rows[9][1]["similar_problems"]) == 3
    assert len(rows[10][1]["similar_problems"]) == 9
    own = {x["content"] for x in memories if x["project_id"] == "other"}
    assert set(rows[2][1]["memories"]) <= own
    assert rows[5][1]["saved"] is True
    # The call for statistics comes after both saves.
    total = len(memories) + sum(rows[i][1]["action"] == "insert" for i in (5, 6))
    assert rows[11][1]["total_memories"] == total > len(memories)
    assert sum(rows[11][1]["memories_by_type"].values()) == total
    assert all("error" in rows[i][1] for i in (4, 7, 8, 12, 13, 14))
