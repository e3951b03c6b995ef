"""Two-stage retrieval: nearest candidates, then rerank and decay."""

from __future__ import annotations

import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.decay import current_importance
from mnemospark.functions.text import search_score
from mnemospark.operators.nearest import nearest_memories
from mnemospark.schema import CANDIDATE_POOL, DEFAULT_TOP_K
from mnemospark.session import broadcast_if_small, materialised

#: Adds a ``relevance`` column to the candidates.
Reranker = Callable[[DataFrame], DataFrame]

PAYLOAD = [
    "user_id",
    "content",
    "memory_type",
    "importance_score",
    "decay_rate",
    "access_count",
    "last_accessed",
]


RESULT = [
    "qid",
    "id",
    "user_id",
    "content",
    "memory_type",
    "importance_score",
    "similarity",
    "rerank_score",
    "score",
    "candidate_rank",
    "rank",
]


def join_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``relevance`` from a score table (qid, id, relevance)."""
    return candidates.join(scores.select("qid", "id", "relevance"), ["qid", "id"], "left")


#: A user function from a query and its candidates' texts to (index, score) pairs.
RerankCall = Callable[[str, list[str]], list]


def call_per_request(call: RerankCall, query: str = "query") -> Reranker:
    """A reranker that makes one call for each request, over all of its candidates.

    ``call(query, contents)`` gets the texts in the order of their similarity and gives
    (index, score) pairs; candidates it leaves out score 0. Each call has a status of its own
    (``rerank_status``): ``answered``, ``failed`` if it raised, or ``malformed`` if its answer is not of
    that form or names a candidate that does not exist. The candidates must carry the
    query text. Answers are written once, so no call is made twice.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("candidate_rank")
        scores, status = _ask(call, group[query].iloc[0], group["content"].tolist())
        return pd.DataFrame({"qid": group["qid"], "id": group["id"], "relevance": scores, "rerank_status": status})

    def rerank(candidates: DataFrame) -> DataFrame:
        candidates = materialised(candidates)
        types = (candidates.schema[c].dataType.simpleString() for c in ("qid", "id"))
        schema = "qid {}, id {}, relevance double, rerank_status string".format(*types)
        asked = candidates.select("qid", "id", "candidate_rank", query, "content")
        answers = materialised(asked.groupBy("qid").applyInPandas(one, schema))
        return candidates.join(answers, ["qid", "id"])

    return rerank


def _ask(call: RerankCall, query: str, contents: list[str]) -> tuple[list, str]:
    none = [None] * len(contents)
    try:
        answer = call(query, contents)
    except Exception:  # whatever the user's function raises
        return none, "failed"
    scores = [0.0] * len(contents)
    try:
        for index, score in answer:
            scores[operator.index(index)] = float(score)
    except (TypeError, ValueError, IndexError):
        return none, "malformed"
    return scores, "answered"


def score_with(
    score: Callable[[pd.Series, pd.Series], pd.Series], query: str = "query"
) -> Reranker:
    """A reranker from a user function over batches of (query text, content).

    The candidates must carry the query text; the function may return NULL for
    a pair it leaves out. Batches hold pairs of many requests; for calls of which each
    can fail by itself see :func:`call_per_request`.
    """
    relevance = F.pandas_udf(score, "double")
    return lambda candidates: candidates.withColumn("relevance", relevance(query, "content"))


def apply_rerank(
    candidates: DataFrame,
    rerank: Reranker | DataFrame | None,
    answered: DataFrame | None = None,
) -> DataFrame:
    """Add ``rerank_score`` to candidates.

    ``rerank`` is a score table or a function that adds a ``relevance`` column.
    A candidate without a score gets 0.0. A request none of whose candidates
    has one is taken for a failed rerank call: all get ``1 / n``. Where the
    caller knows which calls were answered (a table with ``qid``, or a ``rerank_status``
    that the function adds), that decides: an answer without rows gives 0.0 to all.
    """
    if rerank is None:
        scored = candidates.withColumn("relevance", F.lit(None).cast("double"))
    elif callable(rerank):
        scored = rerank(candidates)
    else:
        scored = join_scores(candidates, rerank)
    # One candidate pool per request at most, so these windows stay small.
    per_request = Window.partitionBy("qid")
    uniform = F.lit(1.0) / F.count("*").over(per_request)
    if "rerank_status" in scored.columns:
        has_answer = F.col("rerank_status") == "answered"
    elif answered is None:
        has_answer = F.count("relevance").over(per_request) > 0
    else:
        known = answered.select("qid").distinct().withColumn("answered", F.lit(True))
        scored = scored.join(broadcast_if_small(known), "qid", "left")
        has_answer = F.coalesce("answered", F.lit(False))
    return scored.withColumn(
        "rerank_score",
        F.when(has_answer, F.coalesce("relevance", F.lit(0.0))).otherwise(uniform),
    ).drop("relevance", "answered", "rerank_status")


def rank_candidates(candidates: DataFrame, as_of: Column, top_k: int) -> DataFrame:
    """Decay, score and order candidates; the similarity order breaks ties."""
    score = search_score(
        F.col("rerank_score"), F.col("similarity"), F.col("importance_score")
    )
    # At most one candidate pool of rows per request reaches this window.
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("candidate_rank"))
    return (
        candidates.withColumn("importance_score", current_importance(as_of))
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
    )


def search_memories(
    requests: DataFrame,
    memories: DataFrame,
    rerank: Reranker | DataFrame | None,
    as_of: Column,
    top_k: int = DEFAULT_TOP_K,
    *,
    memory_types: list[str] | None = None,
    answered: DataFrame | None = None,
    **nearest_options,
) -> DataFrame:
    """Best memories of every request.

    Columns: qid, id, user_id, content, memory_type, importance_score (decayed),
    similarity, rerank_score, score, candidate_rank, rank. ``memory_types``
    narrows the search to some types; by default all are searched. ``answered`` (qid)
    names the requests whose rerank call was answered, see :func:`apply_rerank`.
    """
    if memory_types is not None:
        memories = memories.filter(F.col("memory_type").isin(memory_types))
    candidates = nearest_memories(
        requests, memories, CANDIDATE_POOL, columns=PAYLOAD, **nearest_options
    ).withColumnRenamed("rank", "candidate_rank")
    if "query" in requests.columns:
        candidates = candidates.join(requests.select("qid", "query"), "qid")
    ranked = rank_candidates(apply_rerank(candidates, rerank, answered), as_of, top_k)
    return ranked.select(*RESULT)


def contents_in_order(results: DataFrame, first: int) -> DataFrame:
    """Per request the contents of its best ``first`` results as an array."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "content")))
    return (
        results.filter(F.col("rank") <= first)
        .groupBy("qid")
        .agg(F.transform(entries, lambda e: e["content"]).alias("contents"))
    )


def recall_project_context(
    requests: DataFrame, memories: DataFrame, rerank: Reranker | DataFrame | None, as_of: Column, **options
) -> DataFrame:
    """Ten best memories of the request's project, of which five are told."""
    return contents_in_order(
        search_memories(requests, memories, rerank, as_of, DEFAULT_TOP_K, **options), 5
    )


def find_similar_problems(
    requests: DataFrame,
    memories: DataFrame,
    rerank: Reranker | DataFrame | None,
    as_of: Column,
    top_k: int = 3,
    **options,
) -> DataFrame:
    """Best memories over all projects of the user.

    A ``top_k`` column in the request table overrides the argument per request; a
    negative one leaves out as many of the last results.
    """
    anywhere = requests.withColumn("project_id", F.lit(None).cast("string"))
    results = search_memories(anywhere, memories, rerank, as_of, CANDIDATE_POOL, **options)
    if "top_k" in requests.columns:
        limits = requests.select("qid", F.coalesce("top_k", F.lit(top_k)).alias("first"))
        return contents_in_order(told(results.join(limits, "qid")), CANDIDATE_POOL)
    return contents_in_order(results, top_k)


def told(results: DataFrame) -> DataFrame:
    """The ``first`` results of each request, or all but the last of them if it is negative."""
    # At most one candidate pool per request reaches this window.
    found = F.count("*").over(Window.partitionBy("qid"))
    last = F.when(F.col("first") < 0, found + F.col("first")).otherwise(F.col("first"))
    return results.withColumn("last", last).filter(F.col("rank") <= F.col("last")).drop("last")


def search_report(
    requests: DataFrame,
    memories: DataFrame,
    rerank: Reranker | DataFrame | None,
    as_of: Column,
    top_k: int = 5,
    **options,
) -> DataFrame:
    """Search results in the columns a caller is shown."""
    found = search_memories(requests, memories, rerank, as_of, top_k, **options)
    return found.select(
        "qid",
        "rank",
        "content",
        "memory_type",
        "importance_score",
        F.col("similarity").alias("similarity_score"),
        "rerank_score",
    )
