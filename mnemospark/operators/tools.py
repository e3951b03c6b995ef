"""Tool calls as a table: parse, check, route."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.decay import boosted
from mnemospark.operators.extraction import with_strict_json
from mnemospark.operators.lifecycle import after_recalls, append_rows, apply_recalls, upsert_users
from mnemospark.operators.nearest import nearest_memories
from mnemospark.operators.ranking import running
from mnemospark.operators.reports import memory_health
from mnemospark.operators.saving import changes_in_order
from mnemospark.operators.search import (
    PAYLOAD,
    Reranker,
    apply_rerank,
    contents_in_order,
    rank_candidates,
    told,
)
from mnemospark.schema import AT_RISK_THRESHOLD, CANDIDATE_POOL, MEMORY_TYPES, rejection_reason
from mnemospark.session import broadcast_if_small, materialised

# --- fixed values: tool names and defaults ----------------------------------
RECALL = "recall_project_context"
SAVE = "save_developer_insight"
SIMILAR = "find_similar_problems"
HEALTH = "get_memory_health"
DEFAULT_INSIGHT_IMPORTANCE = 0.7
DEFAULT_SIMILAR = 3
INSIGHT_TYPES = ("preference", "decision", "bug_fix", "pattern")
DECLARED_IMPORTANCE = (0.1, 1.0)
REQUIRED_ARGS = {
    RECALL: ("project_id", "current_task"),
    SAVE: ("insight", "memory_type"),
    SIMILAR: ("problem_description",),
    HEALTH: ("user_id",),
}
# ----------------------------------------------------------------------------

#: Memories a recall tells of.
TOLD = 5
#: The number of the call that made a stored row: before any call.
BEFORE_ALL = -(1 << 63)


def _has(args: Column, key: str) -> Column:
    """True if the object has the key, even with a null value."""
    return F.coalesce(
        F.array_contains(F.json_object_keys(args), key), F.lit(False)
    )


def parse_tool_calls(calls: DataFrame) -> DataFrame:
    """Typed arguments of (request_id, user_id, project_id, name, args).

    Adds tool, query (text to search), project_id (the argument where given,
    else the request's), top_k, insight, memory_type, importance_score and
    ``error`` (NULL for a call that can run). The user is always the request's.
    """
    name = F.col("name")
    parsed = with_strict_json(calls, "args", "value")
    object_args = F.coalesce(
        F.schema_of_variant("value").startswith("OBJECT"), F.lit(False)
    )

    def text(key: str) -> Column:
        return F.try_variant_get(F.col("value"), f"$.{key}", "string")

    query = F.when(name == RECALL, text("current_task")).when(
        name == SIMILAR, text("problem_description")
    )
    given_project = _has(F.col("args"), "project_id")
    project = (
        F.when(name == SIMILAR, F.lit(None).cast("string"))
        .when((name == RECALL) & given_project, text("project_id"))
        .otherwise(F.col("project_id"))
    )
    importance = F.when(
        name == SAVE,
        F.when(
            _has(F.col("args"), "importance"),
            F.try_variant_get(F.col("value"), "$.importance", "double"),
        ).otherwise(F.lit(DEFAULT_INSIGHT_IMPORTANCE)),
    )
    # A null limit means all candidates; anything but a whole number is an error.
    limit = F.try_variant_get(F.col("value"), "$.top_k", "variant")
    kind = F.schema_of_variant(limit)
    top_k = F.when(name == RECALL, F.lit(TOLD)).when(
        name == SIMILAR,
        F.when(~_has(F.col("args"), "top_k"), F.lit(DEFAULT_SIMILAR))
        .when(F.is_variant_null(limit), F.lit(CANDIDATE_POOL))
        .when(
            kind.isin("BIGINT", "BOOLEAN"),
            F.greatest(
                F.least(F.try_variant_get(F.col("value"), "$.top_k", "bigint"), F.lit(CANDIDATE_POOL)),
                F.lit(-CANDIDATE_POOL),
            ).cast("int"),
        ),
    )
    insight_kind = F.schema_of_variant(F.try_variant_get(F.col("value"), "$.insight", "variant"))
    typed = parsed.select(
        "request_id",
        (F.col("sequence") if "sequence" in parsed.columns else F.col("request_id")).cast("long").alias("sequence"),
        "user_id",
        project.alias("project_id"),
        name.alias("tool"),
        query.alias("query"),
        top_k.alias("top_k"),
        # Only text is an insight; a number is not turned into one.
        F.when((name == SAVE) & (insight_kind == "STRING"), text("insight")).alias("insight"),
        F.when(name == SAVE, text("memory_type")).alias("memory_type"),
        importance.alias("importance_score"),
        object_args.alias("object_args"),
    )
    broken = rejection_reason(F.col("insight"), F.col("memory_type"), F.col("importance_score"))
    tool = F.col("tool")
    error = (
        F.when(~F.col("object_args"), F.lit("arguments are not a JSON object"))
        .when(~tool.isin(RECALL, SAVE, SIMILAR, HEALTH), F.concat(F.lit("no such tool: "), tool))
        .when(tool.isin(RECALL, SIMILAR) & F.col("query").isNull(), F.lit("missing query"))
        .when((tool == SIMILAR) & F.col("top_k").isNull(), F.lit("invalid top_k"))
        .when((tool == SAVE) & broken.isNotNull(), F.concat(F.lit("invalid "), broken))
    )
    return typed.withColumn("error", error).drop("object_args")


def check_declared_args(calls: DataFrame) -> DataFrame:
    """Report whether each call keeps to the declared argument schema.

    Stricter than running the call: all required keys, a declared insight type,
    importance within the declared range.
    """
    name = F.col("name")
    complete = F.lit(False)
    for tool, keys in REQUIRED_ARGS.items():
        present = F.lit(True)
        for key in keys:
            present = present & _has(F.col("args"), key)
        complete = F.when(name == tool, present).otherwise(complete)
    value = F.get_json_object("args", "$.importance").try_cast("double")
    importance = value.isNull() | value.between(*DECLARED_IMPORTANCE)
    kind = F.get_json_object("args", "$.memory_type")
    declared = (name != SAVE) | (F.coalesce(kind.isin(*INSIGHT_TYPES), F.lit(False)) & importance)
    return calls.select("request_id", "name", (complete & declared).alias("as_declared"))


class ToolRun(NamedTuple):
    """``results``: request_id, tool, result (JSON). ``memories``, ``users``: the next tables."""

    results: DataFrame
    memories: DataFrame
    users: DataFrame | None
    decisions: DataFrame


def run_tool_calls(
    calls: DataFrame,
    query_vectors: DataFrame,
    memories: DataFrame,
    rerank: Reranker | DataFrame | None,
    as_of: Column,
    **options,
) -> DataFrame:
    """The results of :func:`run_tool_calls_table` alone."""
    return run_tool_calls_table(calls, query_vectors, memories, None, rerank, as_of, **options).results


def run_tool_calls_table(
    calls: DataFrame,
    query_vectors: DataFrame,
    memories: DataFrame,
    users: DataFrame | None,
    rerank: Reranker | DataFrame | None,
    as_of: Column,
    new_id: Column | None = None,
    answered: DataFrame | None = None,
    **options,
) -> ToolRun:
    """Run a table of tool calls as if one after another, by ``sequence`` (or request_id).

    ``query_vectors`` gives the embedding of each call's text (request_id, embedding); a
    call that needs one and has none is an error. A call sees the inserts and the boosts
    of earlier calls, and nothing of later ones, although there is only one search for all
    of them: rows of the batch carry the number of the call that made them, boosts are
    counted up to the asking call, and statistics add what changed before it.
    """
    parsed = parse_tool_calls(calls).join(query_vectors.select("request_id", "embedding"), "request_id", "left")
    needs_vector = F.col("tool").isin(RECALL, SIMILAR, SAVE) & F.col("embedding").isNull()
    parsed = materialised(
        parsed.withColumn("error", F.coalesce("error", F.when(needs_vector, F.lit("no embedding of the text"))))
    )
    good = parsed.filter(F.col("error").isNull()).withColumn("qid", F.col("sequence"))

    saves = good.filter(F.col("tool") == SAVE).select(
        F.col("sequence").alias("seq"),
        "user_id",
        "project_id",
        F.col("insight").alias("content"),
        "memory_type",
        "importance_score",
        "embedding",
    )
    saved = changes_in_order(memories, saves, as_of, new_id=new_id, **options)
    inserts = materialised(saved.inserts)
    table = append_rows(memories.withColumn("sequence", F.lit(BEFORE_ALL)), inserts.withColumn("sequence", F.col("seq")))
    id_type = memories.schema["id"].dataType
    new_ids = inserts.select(F.col("seq").alias("target_seq"), F.col("id").cast(id_type).alias("new_id"))
    own_ids = inserts.select("seq", F.col("id").cast(id_type).alias("own_id"))
    done = materialised(
        saved.decisions.join(new_ids, "target_seq", "left")
        .join(own_ids, "seq", "left")
        .select("seq", "action", F.coalesce("id", "new_id", "own_id").alias("id"))
    )
    boosts = done.filter(F.col("action") == "reinforce").select("id", F.col("seq").alias("sequence"))

    asked = good.filter(F.col("tool").isin(RECALL, SIMILAR))
    # Texts are not stored with each candidate: a key names them until a reranker or an answer needs them.
    keyed = table.withColumn("content_key", _text_key("content"))
    queries = asked.select("qid", "query", _text_key("query").alias("query_key"))
    found = nearest_memories(
        asked, keyed, CANDIDATE_POOL, earlier_only=True, columns=[*(c for c in PAYLOAD if c != "content"), "content_key"], **options
    ).withColumnRenamed("rank", "candidate_rank")
    candidates = as_boosted(materialised(found.join(queries.drop("query"), "qid")), boosts, as_of)
    if callable(rerank):
        candidates = _with_text(_with_text(candidates, keyed, "id", "content"), queries, "qid", "query")
    ranked = rank_candidates(apply_rerank(candidates, rerank, answered), as_of, CANDIDATE_POOL)
    limits = asked.select("qid", F.col("top_k").alias("first"))
    shown = told(ranked.join(limits, "qid")).select("qid", "rank", "id", "content_key")
    contents = contents_in_order(_with_text(shown, keyed, "id", "content"), CANDIDATE_POOL)
    listed = F.coalesce("contents", F.array().cast("array<string>"))
    answers = asked.join(contents, "qid", "left").select(
        "request_id",
        "tool",
        F.when(F.col("tool") == RECALL, F.to_json(F.struct(listed.alias("memories"))))
        .otherwise(F.to_json(F.struct(listed.alias("similar_problems"))))
        .alias("result"),
    )
    stored = good.join(done.select(F.col("seq").alias("qid"), "action", "id"), "qid").select(
        "request_id",
        "tool",
        F.to_json(F.struct(F.lit(True).alias("saved"), F.col("id").alias("memory_id"), "action")).alias("result"),
    )
    health = health_in_order(good.filter(F.col("tool") == HEALTH), memories, inserts, boosts, as_of)
    stats = F.to_json(F.struct(*(c for c in health.columns if c not in ("qid", "request_id", "user_id"))))
    results = (
        answers.unionByName(stored)
        .unionByName(health.select("request_id", F.lit(HEALTH).alias("tool"), stats.alias("result")))
        .unionByName(
            parsed.filter(F.col("error").isNotNull()).select(
                "request_id", "tool", F.to_json(F.struct("error")).alias("result")
            )
        )
    )
    return ToolRun(
        results,
        apply_recalls(append_rows(memories, inserts), saved.recalls),
        None if users is None else upsert_users(users, inserts, as_of),
        done,
    )


def _text_key(text: str) -> Column:
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))


def _with_text(rows: DataFrame, texts: DataFrame, owner: str, text: str) -> DataFrame:
    """``rows`` with the text that their ``owner`` and key name, one for each row however often texts repeat."""
    by = [owner, f"{text}_key"]
    return rows.join(texts.select(*by, text).dropDuplicates(by), by)


def as_boosted(candidates: DataFrame, boosts: DataFrame, as_of: Column) -> DataFrame:
    """Candidates of calls (qid is the call's number) as the boosts (id, sequence) before it left them.

    Only candidates that are boosted at all are counted, by running sums over each memory.
    """
    recalled = broadcast_if_small(boosts.select("id").distinct())
    touched = candidates.join(recalled, "id", "left_semi").select("id", "qid")
    moments = materialised(
        boosts.select("id", "sequence", F.lit(1).alias("boost")).unionByName(
            touched.select("id", F.col("qid").alias("sequence"), F.lit(0).alias("boost"))
        )
    )
    counted = running(moments, ["id"], [F.col("sequence"), F.col("boost")], {"recalls": F.col("boost")})
    seen = counted.filter((F.col("boost") == 0) & (F.col("recalls") > 0)).select(
        "id", F.col("sequence").alias("qid"), "recalls", as_of.alias("latest")
    )
    return after_recalls(candidates.join(broadcast_if_small(seen), ["id", "qid"], "left"), candidates)


def health_in_order(
    calls: DataFrame, memories: DataFrame, inserts: DataFrame, boosts: DataFrame, as_of: Column
) -> DataFrame:
    """Statistics of the asking users, each call's as the changes before it left them.

    ``calls``: qid (the call's number), request_id, user_id. The stored rows are summed
    once per user; an insert or boost is a row of differences, added up to each call.
    """
    before = memory_health(calls, memories).join(calls.select("qid", "request_id"), "qid")
    users = broadcast_if_small(calls.select("user_id").distinct())
    risky = (F.col("score") < AT_RISK_THRESHOLD).cast("int")
    kinds = [(F.col("memory_type") == t).cast("int") for t in MEMORY_TYPES]
    made = inserts.join(users, "user_id", "left_semi").withColumn("score", F.col("importance_score"))
    none = [F.lit(0)] * len(MEMORY_TYPES)

    def changes(rows: DataFrame, n: Column, score: Column, risk: Column, by_type: list[Column]) -> DataFrame:
        return rows.select(
            "user_id",
            "sequence",
            n.cast("long").alias("n"),
            score.cast("double").alias("score"),
            risk.cast("long").alias("risk"),
            *[c.cast("long").alias(f"of_{t}") for c, t in zip(by_type, MEMORY_TYPES)],
        )

    recalled = broadcast_if_small(boosts.select("id").distinct())
    id_type = memories.schema["id"].dataType
    scores = (
        memories.select("id", "user_id", "importance_score")
        .unionByName(inserts.select(F.col("id").cast(id_type).alias("id"), "user_id", "importance_score"))
        .join(users, "user_id", "left_semi")
        .join(recalled, "id", "left_semi")
    )
    numbered = running(materialised(boosts), ["id"], [F.col("sequence")], {"earlier": F.lit(1)})
    was = F.when(F.col("earlier") > 0, boosted(F.col("importance_score"), F.col("earlier"))).otherwise(F.col("importance_score"))
    steps = numbered.join(scores, "id").withColumns(
        {"was": was, "score": boosted(F.col("importance_score"), F.col("earlier") + 1)}
    )
    moments = materialised(
        changes(made.withColumn("sequence", F.col("seq")), F.lit(1), F.col("score"), risky, kinds)
        .unionByName(
            changes(
                steps,
                F.lit(0),
                F.col("score") - F.col("was"),
                risky - (F.col("was") < AT_RISK_THRESHOLD).cast("int"),
                none,
            )
        )
        .withColumn("qid", F.lit(None).cast("long"))
        .unionByName(
            changes(calls.withColumn("sequence", F.col("qid")), F.lit(0), F.lit(0), F.lit(0), none).withColumn(
                "qid", F.col("sequence")
            )
        )
    )
    names = ["n", "score", "risk", *(f"of_{t}" for t in MEMORY_TYPES)]
    since = running(moments, ["user_id"], [F.col("sequence")], {f"d_{c}": F.col(c) for c in names})
    both = before.join(since.filter(F.col("qid").isNotNull()).select("qid", *(f"d_{c}" for c in names)), "qid")
    total = F.col("total_memories") + F.col("d_n")
    held = F.coalesce(F.col("avg_importance") * F.col("total_memories"), F.lit(0.0)) + F.col("d_score")
    fresh = F.when(F.col("d_n") > 0, as_of)
    by_type = F.coalesce("memories_by_type", F.create_map().cast("map<string,bigint>"))
    known = F.create_map(
        *(
            x
            for t in MEMORY_TYPES
            for x in (F.lit(t), F.coalesce(F.try_element_at(by_type, F.lit(t)), F.lit(0)) + F.col(f"d_of_{t}"))
        )
    )
    others = F.map_filter(by_type, lambda k, _: ~k.isin(*MEMORY_TYPES))
    merged = F.map_filter(F.map_concat(others, known), lambda _, n: n > 0)
    return both.select(
        "qid",
        "request_id",
        "user_id",
        total.alias("total_memories"),
        F.try_divide(held, total).alias("avg_importance"),
        F.least("oldest_memory", fresh).alias("oldest_memory"),
        F.greatest("newest_memory", fresh).alias("newest_memory"),
        (F.col("memories_at_risk") + F.col("d_risk")).alias("memories_at_risk"),
        F.when(F.size(merged) > 0, merged).alias("memories_by_type"),
    )
