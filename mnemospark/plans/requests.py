"""What one chat turn does, for a table of requests at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.extraction import parse_completions
from mnemospark.operators.lifecycle import append_rows, apply_recalls, reinforce, upsert_users
from mnemospark.operators.packing import context_text, memory_section, pack_memories
from mnemospark.operators.saving import changes_in_order
from mnemospark.operators.search import Reranker, search_memories
from mnemospark.operators.vectors import attach_embeddings
from mnemospark.schema import CANDIDATE_POOL, CONTEXT_TOKENS, REINFORCED_PER_REQUEST
from mnemospark.session import materialised


def build_context(
    requests: DataFrame, results: DataFrame, budget: int = CONTEXT_TOKENS
) -> DataFrame:
    """Context text per request: qid, memories_used, n_used, tokens_used, context.

    Requests without any result keep their row and get the plain text.
    """
    packed = pack_memories(results, budget)
    joined = requests.select("qid").join(packed, "qid", "left")
    section = memory_section(F.col("selected"))
    return joined.select(
        "qid",
        F.col("selected").alias("memories_used"),
        F.coalesce(F.size("selected"), F.lit(0)).alias("n_used"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        context_text(section).alias("context"),
    )


def retrieve_and_build(
    requests: DataFrame,
    memories: DataFrame,
    rerank: Reranker | DataFrame | None,
    as_of: Column,
    budget: int = CONTEXT_TOKENS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Search with the whole candidate pool, then pack: (results, contexts)."""
    results = search_memories(requests, memories, rerank, as_of, CANDIDATE_POOL, **options)
    return results, build_context(requests, results, budget)


def recall_log(
    results: DataFrame, as_of: Column, first: int = REINFORCED_PER_REQUEST
) -> DataFrame:
    """Accesses caused by a search: its first results, packed or not."""
    return results.filter(F.col("rank") <= first).select(
        F.col("id").alias("memory_id"), as_of.alias("ts")
    )


def reinforce_results(memories: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Memory table after the requests of a batch reinforced what they found.

    Contexts are built from the table before this change.
    """
    return reinforce(memories, recall_log(results, as_of))


class Ingested(NamedTuple):
    inserts: DataFrame
    recalls: DataFrame
    decisions: DataFrame
    failed: DataFrame


def ingest_completions(
    memories: DataFrame,
    completions: DataFrame,
    vectors: DataFrame,
    as_of: Column,
    new_id: Column | None = None,
    **options,
) -> Ingested:
    """Parse, embed and save the facts of a batch of completions.

    ``completions``: completion_id (their order), user_id, project_id, raw.
    ``vectors``: text_key, embedding of the facts' texts. ``failed`` holds the
    facts left out for want of a vector; they never stop the others.
    """
    facts = parse_completions(completions).withColumn(
        # Items of one completion follow each other; at most five are read.
        "seq", F.col("completion_id") * 8 + F.col("item_no")
    )
    embedded = materialised(attach_embeddings(facts, vectors))
    ready = embedded.filter(F.col("embedding").isNotNull())
    failed = embedded.filter(F.col("embedding").isNull()).drop("embedding")
    saved = changes_in_order(memories, ready, as_of, new_id=new_id, **options)
    return Ingested(*saved, failed)


def after_ingest(memories: DataFrame, ingested: Ingested) -> DataFrame:
    """Memory table with the inserts and recalls of a batch applied."""
    return apply_recalls(append_rows(memories, ingested.inserts), ingested.recalls)


def users_after_ingest(users: DataFrame, ingested: Ingested, as_of: Column) -> DataFrame:
    """User table with those a batch has inserted the first memories of."""
    return upsert_users(users, ingested.inserts, as_of)
