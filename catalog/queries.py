"""Every registered query: (spark, folder of parquet tables) -> DataFrame.

Timestamps are emitted as text and doubles rounded to six places, so that any
engine can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import schema
from mnemospark.functions import decay, text, vector
from mnemospark.operators import (
    cells,
    extraction,
    lifecycle,
    nearest,
    packing,
    reports,
    saving,
    search,
    tools,
    vectors,
)
from mnemospark.operators import kept_stats as stats_kept
from mnemospark.plans import maintenance, requests
from mnemospark.session import configure, materialised, new_folder
from mnemospark.sources import samples, split, tables
from mnemospark.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OPENING = packing.OPENING
SECTION_HEAD, SECTION_TAIL, CLOSING = packing.SECTION_HEAD, packing.SECTION_TAIL, packing.CLOSING
INSTRUCTION_PROMPT = f"{extraction.INSTRUCTION}\n\n{extraction.CONVERSATION_HEAD}"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def r6_mean(column: str) -> Column:
    """A mean to six places; the nudge keeps exact halves on one side in any engine."""
    return F.round(F.col(column) + 1e-9, 6)


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


AS_OF = samples.as_of


# --- scan, schema, validation ----------------------------------------------


@query
def public_scan(spark, folder):
    return schema.public_view(samples.event_memories(spark, folder)).select(
        "id",
        "user_id",
        "project_id",
        "content",
        "summary",
        "memory_type",
        r6("importance_score").alias("importance_score"),
        "decay_rate",
        "access_count",
        stamp("created_at").alias("created_at"),
        stamp("last_accessed").alias("last_accessed"),
    )


@query
def column_defaults(spark, folder):
    """Events as sparse inserts: some columns are missing or NULL."""
    sparse = samples.event_memories(spark, folder).select(
        "id",
        "user_id",
        F.nullif("memory_type", F.lit("pattern")).alias("memory_type"),
        F.nullif("importance_score", F.lit(1.0)).alias("importance_score"),
    )
    return schema.with_defaults(sparse, AS_OF()).select(
        "id",
        "user_id",
        "memory_type",
        r6("importance_score").alias("importance_score"),
        "decay_rate",
        "access_count",
        "metadata",
        stamp("created_at").alias("created_at"),
        stamp("last_accessed").alias("last_accessed"),
    )


@query
def validate_records(spark, folder):
    events = samples.table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("content"),
        F.when(F.col("event_type") == "signup", F.lit("other"))
        .otherwise(F.lit("decision"))
        .alias("memory_type"),
        (F.col("value") / 100.0).alias("importance_score"),
    )
    return schema.validate_records(events).select("id", "rejected_because")


@query
def scope_keys(spark, folder):
    memories = samples.event_memories(spark, folder)
    workspace = F.when(F.col("access_count") == 1, F.lit("w1")).when(
        F.col("access_count") == 2, F.lit("")
    )
    return memories.select(
        "id",
        schema.scope_key(F.col("user_id"), workspace, F.col("project_id")).alias("scope_key"),
    )


@query
def session_ids(spark, folder):
    e = samples.table(spark, folder, "events")
    given = F.when(F.col("event_type") == "view", F.lit("")).when(
        F.col("event_type") == "click", F.col("props")
    )
    return e.select(
        "event_id",
        schema.session_id_or_derived(given, F.col("user_id"), F.col("event_id")).alias("session_id"),
    )


@query
def vector_text(spark, folder):
    """Vectors to text and back."""
    e = samples.table(spark, folder, "embeddings").select("vec_id", "embedding")
    back = tables.import_vector_text(tables.export_vector_text(e))
    return back.select("vec_id", F.size("embedding").alias("dims"), _by_place("embedding").alias("by_place"))


def _by_place(vector_column: str) -> Column:
    """One number for all entries of a vector and their order."""
    placed = F.transform(vector_column, lambda x, n: x.cast("double") * (n + 1))
    return r6(F.aggregate(placed, F.lit(0.0), lambda total, x: total + x))


@query
def embedding_attach(spark, folder):
    """Vectors of the distinct document texts joined to every document."""
    d = samples.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    e = samples.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    known = (
        d.join(e, "doc_id")
        .groupBy(vectors.text_key("content").alias("text_key"))
        .agg(F.min_by("embedding", "doc_id").alias("embedding"))
    )
    attached = vectors.attach_embeddings(d, known)
    return attached.select("doc_id", F.size("embedding").alias("dims"), _by_place("embedding").alias("by_place"))


def _embed(texts: pd.Series) -> pd.Series:
    """Stand-in for an embedding model; long texts fail, texts without an e get no vector."""
    if (texts.str.len() > 2_000).any():
        raise ValueError("text too long")
    return texts.map(lambda t: [float(len(t)), float(t.count("e"))] if "e" in t else None)


@query
def embed_missing(spark, folder):
    """Documents whose text is in the store keep its vector; the rest are embedded, some in vain."""
    d = samples.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    length = F.col("doc_id").cast("float")
    store = (
        d.filter(F.col("doc_id") % 3 == 0)
        .groupBy(vectors.text_key("content").alias("text_key"))
        .agg(F.min(length).alias("first"))
        .select("text_key", F.array(-F.col("first") - 1, F.lit(-1.0).cast("float")).alias("embedding"))
    )
    done = vectors.embed_missing(d, store, _embed)
    attached = vectors.attach_embeddings(d, done.store).join(done.failed.select("doc_id", "reason"), "doc_id", "left")
    return attached.select(
        "doc_id",
        F.get("embedding", F.lit(0)).cast("double").alias("first_value"),
        F.get("embedding", F.lit(1)).cast("double").alias("second_value"),
        "reason",
    )


@query
def missing_vectors(spark, folder):
    d = samples.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("user_id")
    )
    e = samples.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return nearest.missing_vectors(d.join(e, "id", "left"))


# --- decay -------------------------------------------------------------------


@query
def decay_importance(spark, folder):
    m = samples.event_memories(spark, folder)
    current = decay.current_importance(AS_OF())
    return m.select(
        "id",
        "memory_type",
        "decay_rate",
        r6(decay.days_since(AS_OF(), F.col("last_accessed"))).alias("days"),
        r6(decay.effective_rate(F.col("decay_rate"), F.col("access_count"))).alias("effective_rate"),
        r6(current).alias("current_importance"),
        text.percent(current).alias("percent"),
        decay.should_forget(current).alias("should_forget"),
        r6(decay.boosted(F.col("importance_score"))).alias("boosted"),
    )


@query
def decay_sweep(spark, folder):
    planned = lifecycle.plan_sweep(samples.event_memories(spark, folder), AS_OF())
    return planned.select(
        "id", "user_id", r6("current_importance").alias("current_importance"), "action"
    )


@query
def sweep_counts(spark, folder):
    planned = lifecycle.plan_sweep(samples.event_memories(spark, folder), AS_OF())
    return planned.groupBy("action").agg(F.count("*").alias("n"))


@query
def sweep_result_table(spark, folder):
    swept = lifecycle.sweep(samples.event_memories(spark, folder), AS_OF())
    return swept.select(
        "id",
        "user_id",
        r6("importance_score").alias("importance_score"),
        stamp("last_accessed").alias("last_accessed"),
    )


@query
def sweep_capped(spark, folder):
    """Only the 25 strongest memories of each user are swept."""
    planned = lifecycle.plan_sweep(samples.event_memories(spark, folder), AS_OF(), cap=25)
    return planned.select("id", "user_id", "action")


@query
def sweep_twice(spark, folder):
    """A second sweep decays from the lowered scores again."""
    once = lifecycle.sweep(samples.event_memories(spark, folder), AS_OF())
    twice = lifecycle.plan_sweep(once, AS_OF())
    return twice.select("id", r6("current_importance").alias("current_importance"), "action")


@query
def forgotten_per_user(spark, folder):
    return lifecycle.forgotten_per_user(
        lifecycle.plan_sweep(samples.event_memories(spark, folder), AS_OF())
    )


@query
def forget_times(spark, folder):
    """Memories that have faded out by the reference time."""
    return live.forgotten_by(samples.event_memories(spark, folder), AS_OF()).select(
        "id", F.date_trunc("second", "forget_at").cast("string").alias("forget_at")
    )


# --- reports -----------------------------------------------------------------


def _stats_columns():
    return [
        "total_memories",
        r6_mean("avg_importance").alias("avg_importance"),
        stamp("oldest_memory").alias("oldest_memory"),
        stamp("newest_memory").alias("newest_memory"),
        "memories_at_risk",
    ]


@query
def memory_stats(spark, folder):
    """All customers as users: those without memories keep a row."""
    users = samples.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    stats = reports.memory_stats(samples.event_memories(spark, folder), users)
    return stats.select(
        "user_id",
        *_stats_columns(),
        F.when(F.col("avg_importance").isNull(), text.average_text(F.col("avg_importance")))
        .alias("no_average"),
    )


@query
def memory_stats_by_type(spark, folder):
    return reports.count_by_type(samples.event_memories(spark, folder))


@query
def memories_by_type_map(spark, folder):
    folded = reports.memories_by_type(samples.event_memories(spark, folder))
    pairs = F.transform(
        F.map_entries("memories_by_type"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return folded.select("user_id", F.concat_ws(",", pairs).alias("by_type"))


@query
def type_window_count(spark, folder):
    return reports.with_type_count(samples.event_memories(spark, folder)).select(
        "id", "user_id", "memory_type", "cnt"
    )


@query
def memory_stats_project(spark, folder):
    requests = samples.event_memories(spark, folder).select(
        F.col("id").alias("qid"), "user_id", "project_id"
    )
    stats = reports.memory_stats_project(samples.event_memories(spark, folder), requests)
    return stats.select("qid", "user_id", "project_id", *_stats_columns())


@query
def memory_health(spark, folder):
    """Events of type error stand for the users who ask."""
    asking = (
        samples.table(spark, folder, "events")
        .filter(F.col("event_type") == "error")
        .select(F.col("event_id").alias("qid"), "user_id")
    )
    health = reports.memory_health(asking, samples.event_memories(spark, folder))
    return health.select(
        "qid",
        "user_id",
        *_stats_columns(),
        F.element_at("memories_by_type", F.lit("decision")).alias("decisions"),
    )


@query
def at_risk(spark, folder):
    return reports.at_risk(samples.event_memories(spark, folder)).select(
        "id", "user_id", r6("importance_score").alias("importance_score")
    )


@query
def list_by_user(spark, folder):
    return reports.list_by_user(samples.event_memories(spark, folder)).select(
        "user_id", "rank", "id", r6("importance_score").alias("importance_score")
    )


@query
def list_by_user_project(spark, folder):
    listed = reports.list_by_user(samples.event_memories(spark, folder), project_id="p1")
    return listed.select("user_id", "rank", "id")


@query
def point_lookup(spark, folder):
    wanted = samples.access_log(spark, folder).select(F.col("memory_id").alias("id"))
    return reports.get_by_id(samples.vector_memories(spark, folder), wanted).select(
        "id", "user_id", "memory_type"
    )


@query
def decay_chart_top8(spark, folder):
    chart = reports.decay_chart(samples.vector_memories(spark, folder), AS_OF())
    return chart.select(
        "user_id",
        "rank",
        "id",
        "label",
        "memory_type",
        r6("current_importance").alias("current_importance"),
    )


# --- vector search and packing --------------------------------------------------


@query
def cosine_similarity(spark, folder):
    """Each vector against the next one of its user, and against a zero vector."""
    pairs = samples.next_of_user(samples.table(spark, folder, "embeddings"))
    zero = F.transform("a", lambda x: x * 0)
    return pairs.select(
        "vec_id",
        r6(vector.cosine_similarity(F.col("a"), F.col("b"))).alias("similarity"),
        vector.cosine_similarity(F.col("a"), zero).isNull().alias("zero_is_null"),
    )


@query
def vector_topk_single(spark, folder):
    """One request: the first embedding as the query of its user."""
    first = samples.table(spark, folder, "embeddings").orderBy("vec_id").first()
    found = nearest.find_by_vector(
        samples.vector_memories(spark, folder), first["embedding"], first["vec_id"] % 10
    )
    return found.select("id", r6("similarity").alias("similarity"))


def _topk_columns(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "id", r6("similarity").alias("similarity"))


@query
def vector_topk(spark, folder):
    return _topk_columns(
        nearest.nearest_memories(
            samples.search_requests(spark, folder), samples.vector_memories(spark, folder)
        )
    )


@query
def vector_topk_blocks(spark, folder):
    """The route for large request tables, with the same result."""
    return _topk_columns(
        nearest.nearest_memories(
            samples.search_requests(spark, folder),
            samples.vector_memories(spark, folder),
            broadcast_requests=0,
        )
    )


@query
def vector_topk_all_cells(spark, folder):
    """The approximate search probing every cell is exact."""
    memories = samples.vector_memories(spark, folder)
    centres = nearest.fit_cells(memories, n_cells=8)
    return _topk_columns(
        nearest.nearest_memories_approx(
            samples.search_requests(spark, folder), memories, centres, probes=len(centres)
        )
    )


def _approximate(exact: DataFrame, found: DataFrame, floor: float = 0.9) -> DataFrame:
    """Per request: all found rows of its user and project with their true similarity, and enough of the exact ones."""
    exact, found = materialised(exact), materialised(found)
    best = exact.select("qid", "id", F.col("similarity").alias("exact"))
    worst = exact.groupBy("qid").agg(F.min("similarity").alias("least"), F.count("*").alias("expected"))
    # A found row is one of the exact ones with the same similarity, or not better than the last of them.
    right = F.when(F.col("exact").isNull(), F.col("similarity") < F.col("least") + 1e-9).otherwise(
        F.abs(F.col("similarity") - F.col("exact")) < 1e-9
    )
    judged = (
        found.join(best, ["qid", "id"], "left")
        .join(worst, "qid")
        .groupBy("qid")
        .agg(F.bool_and(right).alias("pairs_exact"), F.count("exact").alias("hits"))
    )
    whole = worst.join(judged, "qid", "left").agg(
        F.sum("hits").alias("hits"), F.sum("expected").alias("expected")
    ).first()
    reached = (whole["hits"] or 0) >= floor * (whole["expected"] or 0)
    return worst.join(judged, "qid", "left").select(
        "qid", F.coalesce("pairs_exact", F.lit(True)).alias("pairs_exact"), F.lit(reached).alias("recall_reached")
    )


@query
def vector_topk_approx(spark, folder):
    """A search in 12 of 16 cells, against the exact one."""
    memories = samples.vector_memories(spark, folder)
    asked = samples.search_requests(spark, folder)
    found = nearest.nearest_memories_approx(asked, memories, nearest.fit_cells(memories, n_cells=16), probes=12)
    return _approximate(nearest.nearest_memories(asked, memories), found)


@query
def vector_topk_cells(spark, folder):
    """A table kept in cells: half of the rows written with it, half added, full cells split, and searched."""
    # Put together once; rows without a vector are in no cell and in no result.
    memories = materialised(samples.vector_memories(spark, folder).filter(F.col("embedding").isNotNull()))
    asked = samples.search_requests(spark, folder)
    path = new_folder(spark, "cells")
    cells.create_cell_table(memories.filter(F.col("id") % 2 == 0), path, n_cells=8)
    cells.append_to_cells(memories.filter(F.col("id") % 2 == 1), path)
    cells.split_full_cells(spark, path, full=200)
    found = cells.search_cells(asked, path, cells.fit_probes(asked, path, recall=0.93))
    return _approximate(nearest.nearest_memories(asked, memories), found)


@query
def rerank_score_join(spark, folder):
    """Scores joined from a table; candidates and requests without scores included."""
    hits = materialised(
        nearest.nearest_memories(
            samples.search_requests(spark, folder), samples.vector_memories(spark, folder)
        )
    )
    relevance = (F.col("qid") * 31 + F.col("id") * 17) % 101 / 100.0
    scores = hits.filter((F.col("qid") % 3 != 0) & (F.col("id") % 7 != 0)).select(
        "qid", "id", relevance.alias("relevance")
    )
    return search.apply_rerank(hits, scores).select(
        "qid", "id", r6("rerank_score").alias("rerank_score")
    )


@query
def rerank_uniform_fallback(spark, folder):
    """Without any rerank answer all candidates score 1/n."""
    found = search.search_memories(
        samples.search_requests(spark, folder),
        samples.vector_memories(spark, folder),
        None,
        AS_OF(),
    )
    return _search_columns(found)


def _search_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "qid",
        "rank",
        "id",
        r6("importance_score").alias("importance_score"),
        r6("similarity").alias("similarity"),
        r6("rerank_score").alias("rerank_score"),
        r6("score").alias("score"),
    )


def _search(spark, folder, top_k=schema.DEFAULT_TOP_K, **options):
    return search.search_memories(
        samples.search_requests(spark, folder),
        samples.vector_memories(spark, folder),
        samples.rerank,
        AS_OF(),
        top_k,
        **options,
    )


def _asked_with_text(spark, folder):
    return samples.search_requests(spark, folder).withColumn("query", F.col("qid").cast("string"))


def _call_model(query_text: str, contents: list[str]) -> list:
    """Stand-in for a rerank call: every fifth request is answered without rows, others in part."""
    number = int(query_text)
    if number % 5 == 0:
        return []
    return [(n, len(c) % 101 / 100.0) for n, c in enumerate(contents) if len(c) % 4]


def _call_unsteady_model(query_text: str, contents: list[str]) -> list:
    """As before, but some calls fail, and some answers name a candidate that does not exist or no score."""
    number = int(query_text)
    if number % 7 == 1:
        raise ConnectionError("no answer")
    if number % 7 == 2:
        return [(len(contents), 0.5)]
    if number % 7 == 3:
        return [(0, None)]
    return _call_model(query_text, contents)


@query
def rerank_answered_empty(spark, folder):
    """One call for each request; an answer without rows gives 0 to all."""
    found = search.search_memories(
        _asked_with_text(spark, folder),
        samples.vector_memories(spark, folder),
        search.call_per_request(_call_model),
        AS_OF(),
    )
    return _search_columns(found)


@query
def rerank_failed(spark, folder):
    """Calls that fail, or answer in another form, give 1/n; the others keep their scores."""
    found = search.search_memories(
        _asked_with_text(spark, folder),
        samples.vector_memories(spark, folder),
        search.call_per_request(_call_unsteady_model),
        AS_OF(),
    )
    return _search_columns(found)


def _score(queries: pd.Series, contents: pd.Series) -> pd.Series:
    """Stand-in for a scoring model over batches of pairs; some pairs have no score."""
    score = (contents.str.len() * 7 + queries.astype(int)) % 101 / 100.0
    return score.where(contents.str.len() % 5 != 0)


@query
def rerank_scored_batches(spark, folder):
    """Scores of a user function over batches of pairs."""
    found = search.search_memories(
        _asked_with_text(spark, folder), samples.vector_memories(spark, folder), search.score_with(_score), AS_OF()
    )
    return _search_columns(found)


@query
def search_answered(spark, folder):
    """A score table beside a table of the calls that were answered."""
    asked = samples.search_requests(spark, folder)
    return _search_columns(_search(spark, folder, answered=asked.filter("qid % 4 <> 0").select("qid")))


@query
def two_stage_search(spark, folder):
    return _search_columns(_search(spark, folder))


@query
def search_by_type(spark, folder):
    """Two-stage search narrowed to two memory types."""
    return _search_columns(_search(spark, folder, memory_types=["decision", "pattern"]))


@query
def search_report(spark, folder):
    found = search.search_report(
        samples.search_requests(spark, folder),
        samples.vector_memories(spark, folder),
        samples.rerank,
        AS_OF(),
    )
    return found.withColumns(
        {c: r6(c) for c in ("importance_score", "similarity_score", "rerank_score")}
    )


def _joined(found: DataFrame) -> DataFrame:
    return found.select(
        "qid", F.size("contents").alias("n"), F.md5(F.concat_ws("|", "contents").cast("binary")).alias("contents_md5")
    )


@query
def recall_project_context(spark, folder):
    return _joined(
        search.recall_project_context(
            samples.search_requests(spark, folder),
            samples.vector_memories(spark, folder),
            samples.rerank,
            AS_OF(),
        )
    )


@query
def find_similar_problems(spark, folder):
    return _joined(
        search.find_similar_problems(
            samples.search_requests(spark, folder),
            samples.vector_memories(spark, folder),
            samples.rerank,
            AS_OF(),
        )
    )


@query
def context_pack(spark, folder):
    packed = packing.pack_memories(_search(spark, folder, schema.CANDIDATE_POOL))
    return packing.selected_rows(packed).select("qid", "position", "id", "cost")


@query
def context_prompt(spark, folder):
    _, contexts = requests.retrieve_and_build(
        samples.search_requests(spark, folder),
        samples.vector_memories(spark, folder),
        samples.rerank,
        AS_OF(),
    )
    return contexts.select("qid", "n_used", "tokens_used", "context")


@query
def oversize_memories(spark, folder):
    return packing.oversize_memories(samples.vector_memories(spark, folder))


@query
def reinforce_after_search(spark, folder):
    memories = samples.vector_memories(spark, folder)
    results = _search(spark, folder, schema.CANDIDATE_POOL)
    return _state_columns(requests.reinforce_results(memories, results, AS_OF()))


# --- state changes -----------------------------------------------------------------


def _state_columns(memories: DataFrame) -> DataFrame:
    return memories.select(
        "id",
        r6("importance_score").alias("importance_score"),
        "access_count",
        stamp("last_accessed").alias("last_accessed"),
    )


@query
def user_upsert(spark, folder):
    events = samples.table(spark, folder, "events")
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    known = (
        events.filter(F.col("event_type") == "signup")
        .select("user_id")
        .distinct()
        .withColumns({"created_at": first, "updated_at": first})
    )
    users = lifecycle.upsert_users(known, events, AS_OF())
    return users.select("user_id", stamp("created_at").alias("created_at"))


@query
def memory_insert(spark, folder):
    table = lifecycle.insert_memories(
        samples.vector_memories(spark, folder),
        samples.incoming_memories(spark, folder),
        AS_OF(),
        new_id=-(F.col("seq") + 1),
    )
    return table.select(
        "id",
        "user_id",
        "project_id",
        "memory_type",
        r6("importance_score").alias("importance_score"),
        "decay_rate",
        "access_count",
        stamp("created_at").alias("created_at"),
    )


@query
def access_log_rollup(spark, folder):
    rolled = lifecycle.roll_up_accesses(samples.access_log(spark, folder))
    return rolled.select("id", "recalls", stamp("latest").alias("latest"))


@query
def reinforce(spark, folder):
    return _state_columns(
        lifecycle.reinforce(
            samples.vector_memories(spark, folder), samples.access_log(spark, folder)
        )
    )


@query
def access_touch(spark, folder):
    return _state_columns(
        lifecycle.touch_access(
            samples.vector_memories(spark, folder), samples.access_log(spark, folder)
        )
    )


@query
def importance_update(spark, folder):
    """Labelled documents get their quality as the new score."""
    scores = samples.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") * 0.75).alias("new_score")
    )
    updated = lifecycle.set_importance(samples.vector_memories(spark, folder), scores)
    return updated.select("id", r6("importance_score").alias("importance_score"))


def _toxic(spark, folder):
    labels = samples.table(spark, folder, "labels").filter(F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("user_id"))


@query
def delete_by_id(spark, folder):
    left = lifecycle.delete_by_id(samples.vector_memories(spark, folder), _toxic(spark, folder))
    return left.select("id", "user_id")


@query
def delete_by_owner(spark, folder):
    left = lifecycle.delete_by_id(
        samples.vector_memories(spark, folder), _toxic(spark, folder), check_owner=True
    )
    return left.select("id", "user_id")


@query
def cascade_delete(spark, folder):
    """Users with a large purchase leave, and their memories with them."""
    events = samples.table(spark, folder, "events")
    gone = events.filter(F.col("value") > 300).select("user_id")
    users, left = lifecycle.delete_users(
        events.select("user_id").distinct(), samples.event_memories(spark, folder), gone
    )
    return (
        left.groupBy("user_id")
        .agg(F.count("*").alias("memories"))
        .join(users, "user_id", "full")
        .select("user_id", F.coalesce("memories", F.lit(0)).alias("memories"))
    )


@query
def split_state(spark, folder):
    """Recalls, new scores, deletions and inserts on a table whose vectors are not moved."""
    table = split.create(samples.vector_memories(spark, folder), new_folder(spark, "split"), buckets=8)
    table = split.reinforce(table, samples.access_log(spark, folder))
    scores = samples.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") * 0.75).alias("new_score")
    )
    table = split.delete(split.set_importance(table, scores), _toxic(spark, folder))
    fresh = lifecycle.new_memories(samples.incoming_memories(spark, folder), AS_OF(), new_id=-(F.col("seq") + 1))
    whole = split.insert(table, fresh).memories()
    return whole.select(
        "id",
        "user_id",
        r6("importance_score").alias("importance_score"),
        "access_count",
        stamp("last_accessed").alias("last_accessed"),
        F.length("content").alias("letters"),
        F.size("embedding").alias("dims"),
    )


@query
def kept_stats(spark, folder):
    """Statistics kept up to date over five batches: inserts, recalls, new scores, deletions, a sweep."""
    everything = samples.event_memories(spark, folder)
    third = F.col("id") % 3 == 0
    stats = stats_kept.start(everything.filter(~third))
    stats = stats_kept.update(stats, None, everything.filter(third), everything)
    rolled = lifecycle.roll_up_accesses(samples.access_log(spark, folder))
    scores = samples.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") * 0.75).alias("new_score")
    )
    before = everything
    for ids, change in (
        (rolled, lambda rows: lifecycle.apply_recalls(rows, rolled)),
        (scores, lambda rows: lifecycle.set_importance(rows, scores)),
    ):
        after = materialised(change(before))
        touched = [rows.join(ids.select("id"), "id", "left_semi") for rows in (before, after)]
        stats = stats_kept.update(stats, *touched, after)
        before = after
    gone = F.col("id") % 11 == 0
    stats = stats_kept.update(stats, before.filter(gone), None, before.filter(~gone))
    planned = materialised(lifecycle.plan_sweep(before.filter(~gone), AS_OF()))
    moved = planned.filter("action <> 'keep'")
    swept = lifecycle.apply_sweep(planned, AS_OF())
    stats = stats_kept.update(stats, moved, lifecycle.apply_sweep(moved, AS_OF()), swept)
    return stats_kept.user_stats(stats).select("user_id", *_stats_columns())


@query
def save_snapshot(spark, folder):
    decisions = saving.decide_snapshot(
        samples.vector_memories(spark, folder), samples.incoming_memories(spark, folder)
    )
    return decisions.withColumn("similarity", r6("similarity"))


@query
def save_snapshot_table(spark, folder):
    table, _ = saving.save_snapshot(
        samples.vector_memories(spark, folder),
        samples.incoming_memories(spark, folder),
        AS_OF(),
        new_id=-(F.col("seq") + 1),
    )
    return _state_columns(table)


@query
def save_ordered(spark, folder):
    decisions = saving.decide_in_order(
        samples.vector_memories(spark, folder), samples.incoming_memories(spark, folder)
    )
    return decisions.withColumn("similarity", r6("similarity"))


@query
def save_ordered_rounds(spark, folder):
    """The rounds for large users and the block route, with the same result."""
    decisions = saving.decide_in_order(
        samples.vector_memories(spark, folder),
        samples.incoming_memories(spark, folder),
        local_rows=20,
        broadcast_requests=0,
    )
    return decisions.withColumn("similarity", r6("similarity"))


@query
def save_ordered_table(spark, folder):
    table, _ = saving.save_in_order(
        samples.vector_memories(spark, folder),
        samples.incoming_memories(spark, folder),
        AS_OF(),
        new_id=-(F.col("seq") + 1),
    )
    return _state_columns(table)


def _forget_commands(spark, folder):
    return samples.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("command_id"),
        (F.col("vec_id") % 10).alias("user_id"),
        F.when(F.col("label").isin(0, 1), F.col("vec_id").cast("string"))
        .when(F.col("label") == 2, F.lit(""))
        .alias("memory_id"),
        ((F.col("label").isin(1, 2)) & (F.col("vec_id") % 10 < 4)).alias("run_decay"),
    )


@query
def forget_commands(spark, folder):
    _, outcome = lifecycle.forget(
        samples.vector_memories(spark, folder), _forget_commands(spark, folder), AS_OF()
    )
    return outcome


@query
def forget_commands_table(spark, folder):
    table, _ = lifecycle.forget(
        samples.vector_memories(spark, folder), _forget_commands(spark, folder), AS_OF()
    )
    return table.select("id", r6("importance_score").alias("importance_score"))


# --- text and tools -----------------------------------------------------------------


@query
def conversation_render(spark, folder):
    return extraction.render_conversations(samples.table(spark, folder, "conversations"))


@query
def conversation_render_user(spark, folder):
    return extraction.render_conversations(
        samples.table(spark, folder, "conversations"), roles=["user"]
    )


@query
def extraction_requests_conversation(spark, folder):
    """One request for each whole conversation."""
    return extraction.extraction_requests(
        samples.table(spark, folder, "conversations"), per="conversation"
    )


@query
def extraction_requests(spark, folder):
    return extraction.extraction_requests(samples.table(spark, folder, "conversations"))


@query
def parse_completions(spark, folder):
    parsed = extraction.parse_completions(samples.completions(spark, folder))
    return parsed.withColumn("importance_score", r6("importance_score"))


@query
def rejected_items(spark, folder):
    rejected = extraction.rejected_items(samples.completions(spark, folder))
    return rejected.select("completion_id", "item_no", "rejected_because", "fatal")


@query
def parse_tool_calls(spark, folder):
    return tools.parse_tool_calls(samples.tool_calls(spark, folder))


@query
def tool_args_check(spark, folder):
    return tools.check_declared_args(samples.tool_calls(spark, folder))


def _tool_run(spark, folder, users=None):
    return tools.run_tool_calls_table(
        samples.tool_calls(spark, folder),
        samples.call_vectors(spark, folder),
        samples.vector_memories(spark, folder),
        users,
        samples.rerank,
        AS_OF(),
        new_id=-(F.col("seq") + 1),
    )


@query
def run_tool_calls(spark, folder):
    """What each call was answered, errors included: texts told, memories saved, statistics."""
    done = _tool_run(spark, folder).results

    def listed(key: str) -> Column:
        contents = F.from_json(F.get_json_object("result", f"$.{key}"), "array<string>")
        return F.md5(F.concat_ws("|", contents).cast("binary"))

    def field(key: str) -> Column:
        return F.get_json_object("result", f"$.{key}")

    total = field("avg_importance").cast("double") * field("total_memories").cast("long")
    health = F.concat_ws(
        "/",
        field("total_memories"),
        field("memories_at_risk"),
        F.coalesce(field("memories_by_type.decision"), F.lit("0")),
        F.floor(total * 100 + 0.5).cast("long").cast("string"),
    )
    outcome = (
        F.when(field("error").isNotNull(), field("error"))
        .when(F.col("tool") == tools.RECALL, listed("memories"))
        .when(F.col("tool") == tools.SIMILAR, listed("similar_problems"))
        .when(F.col("tool") == tools.SAVE, F.concat_ws(" ", field("action"), field("memory_id")))
        .otherwise(health)
    )
    return done.select("request_id", "tool", outcome.alias("outcome"))


@query
def run_tool_calls_table(spark, folder):
    """The memories that a table of tool calls leaves."""
    return _state_columns(_tool_run(spark, folder).memories)


@query
def run_tool_calls_users(spark, folder):
    """Half of the users are known before; saving adds the others."""
    known = samples.vector_memories(spark, folder).filter("user_id < 5").select("user_id").distinct()
    known = known.withColumns({"created_at": AS_OF(), "updated_at": AS_OF()})
    return _tool_run(spark, folder, known).users.select("user_id")


# --- composite jobs ---------------------------------------------------------------


@query
def daily_maintenance(spark, folder):
    """The report of a sweep: forgotten counts and statistics of what is left."""
    result = maintenance.daily_maintenance(samples.event_memories(spark, folder), AS_OF())
    return result.report.select("user_id", "memories_forgotten", *_stats_columns())


@query
def user_panels(spark, folder):
    """Chart rows of the listed memories beside the user's statistics."""
    panel = maintenance.user_panel(samples.event_memories(spark, folder), AS_OF())
    return panel.chart.join(panel.stats, "user_id").select(
        "user_id",
        "rank",
        "id",
        "label",
        r6("current_importance").alias("current_importance"),
        "total_memories",
        "memories_at_risk",
    )


def _fact_vectors(spark, folder):
    """Vectors for the conversation texts, of the same or of another user's memory."""
    vec_id = F.col("conv_id") + F.col("conv_id") % 2 * 5
    turns = samples.table(spark, folder, "conversations").withColumn("vec_id", vec_id)
    e = samples.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return (
        turns.join(e, "vec_id")
        .groupBy(vectors.text_key("text").alias("text_key"))
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
    )


@query
def ingest_facts(spark, folder):
    """Completions parsed, embedded and saved; facts without a vector left out."""
    return _ingested(spark, folder).decisions.withColumn("similarity", r6("similarity"))


def _ingested(spark, folder):
    return requests.ingest_completions(
        samples.vector_memories(spark, folder),
        samples.completions(spark, folder),
        _fact_vectors(spark, folder),
        AS_OF(),
        new_id=-(F.col("seq") + 1),
    )


@query
def ingest_failed(spark, folder):
    """Facts whose text has no vector; they stop no other."""
    return _ingested(spark, folder).failed.select("completion_id", "item_no", "user_id", "content", "memory_type")


@query
def ingest_users(spark, folder):
    """Half of the users are known before; the first facts of the others add them."""
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    known = samples.vector_memories(spark, folder).filter("user_id < 5").select("user_id").distinct()
    known = known.withColumns({"created_at": first, "updated_at": first})
    users = requests.users_after_ingest(known, _ingested(spark, folder), AS_OF())
    return users.select("user_id", stamp("created_at").alias("created_at"))


@query
def insert_users(spark, folder):
    """Inserting memories adds their users."""
    known = samples.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")).filter("user_id % 2 = 0")
    known = known.withColumns({"created_at": AS_OF(), "updated_at": AS_OF()})
    users, memories = lifecycle.insert_with_users(
        known, samples.vector_memories(spark, folder), samples.incoming_memories(spark, folder), AS_OF(), -(F.col("seq") + 1)
    )
    counts = memories.groupBy("user_id").agg(F.count("*").alias("memories"))
    return users.join(counts, "user_id", "left").select("user_id", F.coalesce("memories", F.lit(0)).alias("memories"))


# --- streams ------------------------------------------------------------------------


def _event_stream(spark, folder):
    """The events file as a stream of created memories."""
    declared = samples.SCHEMAS["events"]
    return spark.readStream.schema(declared).parquet(f"{folder}/events*.parquet")


def _run_to_parquet(writer, spark, schema_of: DataFrame) -> DataFrame:
    where = new_folder(spark, "stream")
    stream = (
        writer.format("parquet")
        .option("checkpointLocation", f"{where}/state")
        .option("path", f"{where}/out")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema(schema_of.schema).parquet(f"{where}/out")


def _run_updates(result: DataFrame, key: str) -> DataFrame:
    """Run a stream in update mode; the last row written for each key."""
    where = new_folder(result.sparkSession, "stream")
    stream = (
        live.update_sink(result, f"{where}/out")
        .option("checkpointLocation", f"{where}/state")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return live.latest_updates(result.sparkSession, f"{where}/out", result.schema, key)


def _created(spark, folder):
    return _event_stream(spark, folder).select(
        F.col("event_id").alias("id"),
        "user_id",
        F.least(F.lit(1.0), F.col("value") / 200.0).alias("importance_score"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


@query
def stream_user_stats(spark, folder):
    stats = _run_updates(live.stats_stream(_created(spark, folder)), "user_id")
    return stats.select("user_id", *_stats_columns())


@query
def stream_access_counts(spark, folder):
    log = samples.as_access_log(_event_stream(spark, folder))
    counts = _run_updates(live.access_counts_stream(log), "id")
    return counts.select("id", "recalls", stamp("latest").alias("latest"))


@query
def stream_access_replayed(spark, folder):
    """A log that is delivered twice, in two micro-batches, counts once."""
    log = samples.access_log(spark, folder).coalesce(1)
    arrived = new_folder(spark, "arrived")
    for _ in range(2):
        log.write.mode("append").parquet(arrived)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    path = new_folder(spark, "live")
    live.create_live_table(samples.vector_memories(spark, folder), path, buckets=8)
    _run(live.access_stream(stream, path, lateness="60 days"), spark)
    return _state_columns(live.current_memories(spark, path))


@query
def stream_windowed_stats(spark, folder):
    """Daily windows that the watermark has closed."""
    closed = live.windowed_stats_stream(_created(spark, folder), "1 day", "1 hour")
    out = _run_to_parquet(closed.writeStream.outputMode("append"), spark, closed)
    return out.select(
        stamp("start").alias("start"),
        "user_id",
        "created",
        r6_mean("avg_importance").alias("avg_importance"),
    )


def _run(writer, spark) -> None:
    stream = (
        writer.option("checkpointLocation", new_folder(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


@query
def stream_access_table(spark, folder):
    """A live table after an access-log stream: equal to the batch reinforcement."""
    path = new_folder(spark, "live")
    live.create_live_table(samples.vector_memories(spark, folder), path, buckets=8)
    log = samples.as_access_log(_event_stream(spark, folder))
    _run(live.access_stream(log, path), spark)
    return _state_columns(live.current_memories(spark, path))


@query
def stream_ingest_table(spark, folder):
    """A live table after a stream of completions: equal to the batch ingest."""
    path = new_folder(spark, "live")
    live.create_live_table(samples.vector_memories(spark, folder), path, buckets=8)
    declared = samples.SCHEMAS["conversations"]
    turns = spark.readStream.schema(declared).parquet(f"{folder}/conversations*.parquet")
    known = materialised(_fact_vectors(spark, folder))

    def save(before: DataFrame, batch: DataFrame) -> requests.Ingested:
        return requests.ingest_completions(
            before, batch, known, AS_OF(), new_id=-(F.col("seq") + 1)
        )

    _run(live.ingest_stream(samples.as_completions(turns), path, save), spark)
    return _state_columns(live.current_memories(spark, path))


@query
def stream_forget_timers(spark, folder):
    """Memories whose forget time event time has passed, from timers."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    created = samples.as_event_memories(_event_stream(spark, folder))
    due = live.forget_timer_stream(created)
    out = _run_to_parquet(due.writeStream.outputMode("append"), spark, due)
    return out.select("id", F.date_trunc("second", "forget_at").cast("string").alias("forget_at"))
