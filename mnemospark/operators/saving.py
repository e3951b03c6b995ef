"""Saving a batch of memories with the near-duplicate check.

``incoming``: seq (unique, the order of the saves), user_id, project_id, content,
memory_type, importance_score, embedding.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.blocks import SIMILARITY_DECIMALS, Block
from mnemospark.operators.lifecycle import (
    append_rows,
    apply_recalls,
    insert_memories,
    new_memories,
    reinforce,
    roll_up_accesses,
)
from mnemospark.operators.nearest import nearest_memories
from mnemospark.operators.ranking import top_k_per_group
from mnemospark.schema import DUPLICATE_SIMILARITY
from mnemospark.session import broadcast_if_small, materialised

#: A user with at most this many undecided rows is settled in one task.
LOCAL_ROWS = 4_096


def _requests(incoming: DataFrame) -> DataFrame:
    return incoming.select(
        F.col("seq").alias("qid"),
        "user_id",
        "project_id",
        "embedding",
        F.col("seq").alias("sequence"),
    )


def _as_memories(incoming: DataFrame) -> DataFrame:
    return incoming.select(
        F.col("seq").alias("id"),
        "user_id",
        "project_id",
        "importance_score",
        "embedding",
        F.col("seq").alias("sequence"),
    )


def _nearest_stored(
    memories: DataFrame, incoming: DataFrame, threshold: float, **options
) -> DataFrame:
    hits = nearest_memories(
        _requests(incoming), memories, 1, min_similarity=threshold, **options
    )
    return hits.select(F.col("qid").alias("seq"), "id", "similarity")


def decide_snapshot(
    memories: DataFrame,
    incoming: DataFrame,
    threshold: float = DUPLICATE_SIMILARITY,
    **options,
) -> DataFrame:
    """Decide each save against the table as it was before the batch.

    One row per save: seq, action (reinforce, insert, or failed for a save whose
    text could not be embedded), id of the reinforced memory, similarity.
    """
    hits = _nearest_stored(memories, incoming, threshold, **options)
    saves = incoming.select("seq", F.col("embedding").isNull().alias("no_vector"))
    return saves.join(hits, "seq", "left").select(
        "seq",
        F.when(F.col("no_vector"), "failed")
        .when(F.col("id").isNotNull(), "reinforce")
        .otherwise("insert")
        .alias("action"),
        "id",
        "similarity",
    )


def save_snapshot(
    memories: DataFrame,
    incoming: DataFrame,
    as_of: Column,
    threshold: float = DUPLICATE_SIMILARITY,
    new_id: Column | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Next memory table and the decisions of :func:`decide_snapshot`."""
    incoming = materialised(incoming)
    decisions = materialised(decide_snapshot(memories, incoming, threshold, **options))
    log = decisions.filter(F.col("action") == "reinforce").select(
        F.col("id").alias("memory_id"), as_of.alias("ts")
    )
    fresh = incoming.join(
        decisions.filter(F.col("action") == "insert").select("seq"), "seq", "left_semi"
    )
    return insert_memories(reinforce(memories, log), fresh, as_of, new_id), decisions


def decide_in_order(
    memories: DataFrame,
    incoming: DataFrame,
    threshold: float = DUPLICATE_SIMILARITY,
    local_rows: int = LOCAL_ROWS,
    **options,
) -> DataFrame:
    """Decide saves one after another: each sees the inserts before it.

    One row per save: seq, action, target (``stored`` or ``batch``), id of a
    stored memory, target_seq of a memory inserted by this batch, similarity.
    A save whose text could not be embedded fails alone.

    A save is an insert exactly if no stored memory and no earlier insert is
    near, so the inserts are found first (:func:`_earliest_distinct`) and all
    other rows are then matched to the nearest memory they could see.
    """
    # Read several times below, and its vectors may come from a costly function.
    incoming = materialised(incoming)
    options = {"requests_stored": True, **options}
    stored_hits = materialised(_nearest_stored(memories, incoming, threshold, **options))
    unmatched = incoming.filter(F.col("embedding").isNotNull()).join(
        stored_hits, "seq", "left_anti"
    )
    # A row saved with importance zero is never found by later searches.
    visible = unmatched.filter(F.col("importance_score") > 0.0)
    leaders = broadcast_if_small(
        _earliest_distinct(_as_memories(visible), threshold, local_rows, **options)
    )
    inserted = _as_memories(incoming.join(leaders, "seq", "left_semi"))
    others = incoming.join(leaders, "seq", "left_anti")
    batch_hits = nearest_memories(
        _requests(others), inserted, 1, min_similarity=threshold, earlier_only=True, **options
    ).select(
        F.col("qid").alias("seq"),
        F.col("id").alias("target_seq"),
        F.col("similarity").alias("batch_similarity"),
    )
    batch_wins = F.coalesce("batch_similarity", F.lit(-2.0)) > F.coalesce(
        "similarity", F.lit(-2.0)
    )
    target = F.when(batch_wins, "batch").when(F.col("id").isNotNull(), "stored")
    return (
        incoming.select("seq", F.col("embedding").isNull().alias("no_vector"))
        .join(stored_hits, "seq", "left")
        .join(batch_hits, "seq", "left")
        .withColumn("target", target)
        .select(
            "seq",
            F.when(F.col("no_vector"), "failed")
            .when(F.col("target").isNull(), "insert")
            .otherwise("reinforce")
            .alias("action"),
            "target",
            F.when(F.col("target") == "stored", F.col("id")).alias("id"),
            F.when(F.col("target") == "batch", F.col("target_seq")).alias("target_seq"),
            F.greatest("similarity", "batch_similarity").alias("similarity"),
        )
    )


class SavedBatch(NamedTuple):
    """What a batch of saves changes, and why.

    The users of ``inserts`` are users from then on (:func:`lifecycle.upsert_users`).
    """

    inserts: DataFrame
    recalls: DataFrame
    decisions: DataFrame


def changes_in_order(
    memories: DataFrame,
    incoming: DataFrame,
    as_of: Column,
    threshold: float = DUPLICATE_SIMILARITY,
    new_id: Column | None = None,
    **options,
) -> SavedBatch:
    """Rows to insert and recalls (id, recalls, latest) that the saves amount to."""
    incoming = materialised(incoming)
    decisions = materialised(decide_in_order(memories, incoming, threshold, **options))
    fresh = incoming.join(
        decisions.filter(F.col("action") == "insert").select("seq"), "seq", "left_semi"
    )
    inserts = new_memories(fresh, as_of, new_id)
    # Hits on rows of this batch find the new ids by seq.
    new_ids = inserts.select(
        F.col("seq").alias("target_seq"), F.col("id").cast(memories.schema["id"].dataType)
    )
    on_stored = decisions.filter(F.col("target") == "stored").select("id")
    on_batch = (
        decisions.filter(F.col("target") == "batch")
        .select("target_seq")
        .join(new_ids, "target_seq")
        .select("id")
    )
    recalls = roll_up_accesses(
        on_stored.unionByName(on_batch).select(F.col("id").alias("memory_id"), as_of.alias("ts"))
    )
    return SavedBatch(inserts, recalls, decisions)


def save_in_order(
    memories: DataFrame,
    incoming: DataFrame,
    as_of: Column,
    threshold: float = DUPLICATE_SIMILARITY,
    new_id: Column | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Next memory table and the decisions of :func:`decide_in_order`."""
    saved = changes_in_order(memories, incoming, as_of, threshold, new_id, **options)
    table = append_rows(memories, saved.inserts)
    return apply_recalls(table, saved.recalls), saved.decisions


def _earliest_distinct(
    rows: DataFrame, threshold: float, local_rows: int, **options
) -> DataFrame:
    """``seq`` of the rows kept when each is dropped that is near an earlier kept one.

    Users with few undecided rows are walked in order inside one task each. The
    rest go through rounds. In a round each user's first ``local_rows`` undecided rows are
    walked; of the rows behind them, those without a neighbour among kept first rows and
    earlier undecided ones are kept, rows near a kept one are dropped, and the others stay. A group of copies of any size is settled in one round, because a row
    reports only whether it has such a neighbour, never its list of neighbours; and as
    every round decides a user's first ``local_rows`` rows, a chain of drifting rows takes
    no more than its length over ``local_rows`` rounds.
    """
    undecided = materialised(rows)
    kept: DataFrame | None = None
    while True:
        per_user = undecided.groupBy("user_id").agg(F.count("*").alias("n"))
        heavy = materialised(per_user.filter(F.col("n") > local_rows).select("user_id"))
        if heavy.isEmpty():
            return _union(kept, _walk_users(undecided, threshold))
        heavy = broadcast_if_small(heavy)
        # Of users that are not heavy any more all rows are first ones.
        first = materialised(
            _first_rows(undecided.join(heavy, "user_id", "left_semi"), local_rows).unionByName(
                undecided.join(heavy, "user_id", "left_anti")
            )
        )
        walked = materialised(_walk_users(first, threshold))
        kept = _union(kept, walked)
        heads = first.join(walked.select(F.col("seq").alias("id")), "id", "left_semi")
        rest = materialised(undecided.join(first.select("id"), "id", "left_anti"))
        rule = {"min_similarity": threshold, "earlier_only": True, "requests_stored": True, **options}
        blocked = _near(rest, heads.unionByName(rest), rule)
        leaders = materialised(rest.join(blocked, "id", "left_anti"))
        kept = _union(kept, leaders.select(F.col("id").alias("seq")))
        followers = materialised(rest.join(leaders.select("id"), "id", "left_anti"))
        near = _near(followers, heads.unionByName(leaders), rule)
        undecided = materialised(followers.join(near, "id", "left_anti"))


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """Each user's first rows by sequence; vectors are not sorted, only their numbers."""
    numbers = top_k_per_group(
        rows.select("user_id", "id", "sequence"), ["user_id"], [F.col("sequence")], n, split_on="id"
    )
    return rows.join(broadcast_if_small(numbers.select("id")), "id", "left_semi")


def _near(rows: DataFrame, others: DataFrame, rule: dict) -> DataFrame:
    """``id`` of the rows with a match among earlier ``others``."""
    found = nearest_memories(rows.withColumnRenamed("id", "qid"), others, 1, **rule)
    return found.select(F.col("qid").alias("id"))


def _union(left: DataFrame | None, right: DataFrame) -> DataFrame:
    return right if left is None else left.unionByName(right)


def _walk_users(rows: DataFrame, threshold: float) -> DataFrame:
    """The ordered walk for users whose rows fit one task."""
    schema = T.StructType([T.StructField("seq", rows.schema["id"].dataType)])

    def walk(table: pa.Table) -> pa.Table:
        block = Block.read(table.rename_columns({"user_id": "scope"}), "sequence")
        everywhere = np.array([p is None or p == "" for p in block.project])
        kept: list[int] = []
        kept_units = np.empty_like(block.unit)
        kept_projects = np.empty_like(block.project)
        for at in range(len(block.unit)):
            n = len(kept)
            cosine = np.round(kept_units[:n] @ block.unit[at], SIMILARITY_DECIMALS)
            near = cosine >= threshold
            if not everywhere[at]:
                near &= kept_projects[:n] == block.project[at]
            if not near.any():
                kept_units[n] = block.unit[at]
                kept_projects[n] = block.project[at]
                kept.append(at)
        return pa.table({"seq": block.ids.take(pa.array(kept, pa.int64()))})

    return rows.groupBy("user_id").applyInArrow(walk, schema)
