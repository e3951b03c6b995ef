"""Lists, statistics and chart data per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.decay import current_importance
from mnemospark.functions.text import chart_label
from mnemospark.operators.ranking import top_k_per_group
from mnemospark.schema import (
    AT_RISK_THRESHOLD,
    CHART_BARS,
    LIST_LIMIT,
)
from mnemospark.session import broadcast_if_small


def in_scope(
    memories: DataFrame, user_id=None, project_id: str | None = None
) -> DataFrame:
    """Filter to one user and, unless missing or empty, one project."""
    if user_id is not None:
        memories = memories.filter(F.col("user_id") == F.lit(user_id))
    if project_id:
        memories = memories.filter(F.col("project_id") == F.lit(project_id))
    return memories


#: Columns no caller is shown; left out before anything is sorted or shuffled.
HIDDEN = ("session_id", "embedding", "metadata", "expires_at")


def list_by_user(
    memories: DataFrame, project_id: str | None = None, limit: int = LIST_LIMIT
) -> DataFrame:
    """Per user the memories of highest stored importance.

    Only ids and scores are ranked; the texts of the listed rows are fetched afterwards, so
    none is shuffled that is not listed.
    """
    scoped = in_scope(memories, project_id=project_id).drop(*HIDDEN)
    ranked = top_k_per_group(
        scoped.select("user_id", "id", "importance_score"),
        ["user_id"],
        [F.col("importance_score").desc(), F.col("id")],
        limit,
        split_on="id",
    )
    return scoped.join(broadcast_if_small(ranked.select("id", "rank")), "id").select(*scoped.columns, "rank")


def get_by_id(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids; an unknown id is simply absent."""
    wanted = broadcast_if_small(ids.select("id").distinct())
    return memories.drop(*HIDDEN).join(wanted, "id", "left_semi")


def at_risk(memories: DataFrame) -> DataFrame:
    return memories.filter(F.col("importance_score") < AT_RISK_THRESHOLD)


def decay_chart(memories: DataFrame, as_of: Column, bars: int = CHART_BARS) -> DataFrame:
    """Per user the memories with the most importance left, with chart labels."""
    current = memories.select(
        "user_id",
        "id",
        chart_label(F.col("content")).alias("label"),
        "memory_type",
        current_importance(as_of).alias("current_importance"),
    )
    # The short label is cut before the ranking, so no text is shuffled.
    return top_k_per_group(
        current,
        ["user_id"],
        [F.col("current_importance").desc(), F.col("id")],
        bars,
        split_on="id",
    )


def _aggregates() -> list[Column]:
    return [
        F.count("user_id").alias("total_memories"),
        F.avg("importance_score").alias("avg_importance"),
        F.min("created_at").alias("oldest_memory"),
        F.max("created_at").alias("newest_memory"),
        F.count_if(F.col("importance_score") < AT_RISK_THRESHOLD).alias("memories_at_risk"),
    ]


def memory_stats(memories: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Count, average, oldest, newest and at-risk count per user.

    With ``users`` every listed user has a row: zero counts and NULLs when empty.
    """
    stats = memories.groupBy("user_id").agg(*_aggregates())
    return stats if users is None else _for_users(stats, users)


def _for_users(stats: DataFrame, users: DataFrame) -> DataFrame:
    filled = users.select("user_id").distinct().join(stats, "user_id", "left")
    counts = [c for c in ("total_memories", "memories_at_risk") if c in stats.columns]
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def memory_stats_project(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Statistics for requests (qid, user_id, project_id).

    Memories are first reduced to one partial row per user and project; requests
    then combine those few rows, so no request is joined to a user's memories.
    The importance sums of the parts give the average of the whole.
    """
    parts = memories.groupBy("user_id", "project_id").agg(
        F.count("*").alias("n"),
        F.sum("importance_score").alias("importance_sum"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.count_if(F.col("importance_score") < AT_RISK_THRESHOLD).alias("risky"),
    )
    whole = parts.groupBy("user_id").agg(
        F.sum("n").alias("n"),
        F.sum("importance_sum").alias("importance_sum"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.sum("risky").alias("risky"),
    )
    # The whole-user rows carry the key '' that a request without project has.
    lookup = whole.withColumn("project_key", F.lit("")).unionByName(
        parts.filter(F.coalesce("project_id", F.lit("")) != "")
        .withColumn("project_key", F.col("project_id"))
        .drop("project_id")
    )
    wanted = requests.select("qid", "user_id", "project_id").withColumn(
        "project_key", F.coalesce("project_id", F.lit(""))
    )
    return wanted.join(lookup, ["user_id", "project_key"], "left").select(
        "qid",
        "user_id",
        "project_id",
        F.coalesce("n", F.lit(0)).alias("total_memories"),
        (F.col("importance_sum") / F.col("n")).alias("avg_importance"),
        F.col("oldest").alias("oldest_memory"),
        F.col("newest").alias("newest_memory"),
        F.coalesce("risky", F.lit(0)).alias("memories_at_risk"),
    )


def count_by_type(memories: DataFrame) -> DataFrame:
    """Long form: one row per user and type."""
    return memories.groupBy("user_id", "memory_type").agg(F.count("*").alias("cnt"))


def memories_by_type(memories: DataFrame) -> DataFrame:
    """Per user a map from type to count, folded from one row per type."""
    entries = F.sort_array(F.collect_list(F.struct("memory_type", "cnt")))
    return (
        count_by_type(memories)
        .groupBy("user_id")
        .agg(F.map_from_entries(entries).alias("memories_by_type"))
    )


def with_type_count(memories: DataFrame) -> DataFrame:
    """Every memory with the size of its (user, type) group.

    A window would pull a whole group into one task; the counts are aggregated
    map-side instead and joined back, broadcast when few.
    """
    counts = count_by_type(memories).select(
        F.col("user_id").alias("_user"), F.col("memory_type").alias("_type"), "cnt"
    )
    same_group = (F.col("user_id") == F.col("_user")) & F.col("memory_type").eqNullSafe(
        F.col("_type")
    )
    shown = memories.drop(*HIDDEN)
    return shown.join(broadcast_if_small(counts), same_group).drop("_user", "_type")


def full_stats(memories: DataFrame) -> DataFrame:
    """Statistics and type counts per user in one pass over the memories."""
    return _stats_of(memories, F.lit(True), F.col("importance_score")).drop("left_out")


def sweep_report(planned: DataFrame) -> DataFrame:
    """Per user how many memories a planned sweep forgets, and statistics of the rest."""
    score = F.when(F.col("action") == "update", F.col("current_importance")).otherwise(
        F.col("importance_score")
    )
    return _stats_of(planned, F.col("action") != "forget", score).withColumnRenamed(
        "left_out", "memories_forgotten"
    )


def _stats_of(rows: DataFrame, kept: Column, score: Column) -> DataFrame:
    """One pass: first per user and type, then per user from those few rows."""

    def of_kept(column: Column) -> Column:
        return F.when(kept, column)

    by_type = rows.groupBy("user_id", "memory_type").agg(
        F.count_if(kept).alias("n"),
        F.count_if(~kept).alias("left_out"),
        F.sum(of_kept(score)).alias("importance_sum"),
        F.min(of_kept(F.col("created_at"))).alias("oldest"),
        F.max(of_kept(F.col("created_at"))).alias("newest"),
        F.count_if(kept & (score < AT_RISK_THRESHOLD)).alias("risky"),
    )
    entry = F.when(F.col("n") > 0, F.struct("memory_type", "n"))
    return by_type.groupBy("user_id").agg(
        F.sum("n").alias("total_memories"),
        F.try_divide(F.sum("importance_sum"), F.sum("n")).alias("avg_importance"),
        F.min("oldest").alias("oldest_memory"),
        F.max("newest").alias("newest_memory"),
        F.sum("risky").alias("memories_at_risk"),
        F.sum("left_out").alias("left_out"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("memories_by_type"),
    )


def memory_health(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """Statistics and type counts for the users that ask."""
    users = requests.select("user_id").distinct()
    wanted = memories.join(broadcast_if_small(users), "user_id", "left_semi")
    stats = _for_users(full_stats(wanted), users)
    return requests.select("qid", "user_id").join(stats, "user_id")
