"""State changes: a memory table in, the next version of it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.decay import (
    boosted,
    current_importance,
    days_since,
    decay_rate_for_type,
    decayed_importance,
    sweep_action,
)
from mnemospark.operators.ranking import running, top_k_per_group
from mnemospark.schema import WRITE_BACK_EPSILON, with_defaults
from mnemospark.session import broadcast_if_small, materialised


#: Recalled memories (id, count, time: about 100 bytes) that may be broadcast.
RECALL_BROADCAST_ROWS = 1_000_000


def upsert_users(users: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Users with the unknown ones of ``incoming`` added; known ones stay as they are."""
    fresh = (
        incoming.select("user_id")
        .distinct()
        .join(users.select("user_id"), "user_id", "left_anti")
        .withColumns({"created_at": as_of, "updated_at": as_of})
    )
    return users.unionByName(fresh, allowMissingColumns=True)


def derived_id(key: str = "seq") -> Column:
    """An id that a rerun of the same insert gives again."""
    parts = (F.col(c).cast("string") for c in ("user_id", "content", key))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def new_memories(rows: DataFrame, as_of: Column, new_id: Column | None = None) -> DataFrame:
    """Rows to insert: id, decay rate of the type, defaults, fresh counters."""
    return with_defaults(rows, as_of).withColumns(
        {
            "id": derived_id() if new_id is None else new_id,
            "decay_rate": decay_rate_for_type(F.col("memory_type")),
            "access_count": F.lit(0),
            "created_at": as_of,
            "last_accessed": as_of,
        }
    )


def insert_memories(
    memories: DataFrame, rows: DataFrame, as_of: Column, new_id: Column | None = None
) -> DataFrame:
    """Memory table with ``rows`` added."""
    return append_rows(memories, new_memories(rows, as_of, new_id))


def insert_with_users(
    users: DataFrame, memories: DataFrame, rows: DataFrame, as_of: Column, new_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """User and memory table with ``rows`` added, and the users they are the first ones of."""
    return upsert_users(users, rows, as_of), insert_memories(memories, rows, as_of, new_id)


def append_rows(memories: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union under the memory table's columns and types."""
    return memories.unionByName(
        fresh.select(
            *(F.col(f.name).cast(f.dataType) for f in memories.schema if f.name in fresh.columns)
        ),
        allowMissingColumns=True,
    )


def roll_up_accesses(log: DataFrame) -> DataFrame:
    """Access log (memory_id, ts) to one row per memory: count and latest time.

    Aggregated map-side, so a memory holding most of the log is no hot spot. If the log
    has an ``event_id``, an event that it holds twice counts once.
    """
    if "event_id" in log.columns:
        log = log.dropDuplicates(["event_id"])
    return log.groupBy(F.col("memory_id").alias("id")).agg(
        F.count("*").alias("recalls"), F.max("ts").alias("latest")
    )


def reinforce(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Boost every recalled memory and track its accesses.

    ``n`` recalls in a row are ``min(1, stored + 0.2 n)``, so one aggregate
    replaces the sequence. Unknown ids change nothing; a log entry older than
    the stored access time does not move it back.
    """
    return apply_recalls(memories, roll_up_accesses(log))


def touch_access(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Access count and time only, without the boost."""
    return apply_recalls(memories, roll_up_accesses(log), boost=False)


def merge_recalls(recalls: DataFrame) -> DataFrame:
    """Several roll-ups (id, recalls, latest) to one row per memory."""
    return recalls.groupBy("id").agg(
        F.sum("recalls").alias("recalls"), F.max("latest").alias("latest")
    )


def apply_recalls(memories: DataFrame, recalls: DataFrame, boost: bool = True) -> DataFrame:
    """Memory table after the rolled-up recalls (id, recalls, latest)."""
    # Worth a larger broadcast: the alternative shuffles whole memories.
    joined = memories.join(broadcast_if_small(recalls, RECALL_BROADCAST_ROWS), "id", "left")
    return after_recalls(joined, memories, boost)


def after_recalls(joined: DataFrame, memories: DataFrame, boost: bool = True) -> DataFrame:
    """The columns of ``memories`` after the ``recalls`` up to ``latest`` joined to each row (or null)."""
    recalled = F.col("recalls").isNotNull()
    stored = F.col("importance_score")
    changes = {
        "access_count": F.col("access_count")
        + F.coalesce("recalls", F.lit(0)).cast(memories.schema["access_count"].dataType),
        "last_accessed": F.greatest(
            "last_accessed", F.col("latest").cast(memories.schema["last_accessed"].dataType)
        ),
    }
    if boost:
        changes["importance_score"] = F.when(
            recalled, boosted(stored, F.col("recalls"))
        ).otherwise(stored)
    return joined.withColumns(changes).select(*memories.columns)


def set_importance(memories: DataFrame, scores: DataFrame) -> DataFrame:
    """Set the stored score of the ids in ``scores`` (id, new_score)."""
    joined = memories.join(broadcast_if_small(scores.select("id", "new_score")), "id", "left")
    return joined.withColumn(
        "importance_score", F.coalesce("new_score", "importance_score")
    ).select(*memories.columns)


def delete_by_id(
    memories: DataFrame, deletions: DataFrame, check_owner: bool = False
) -> DataFrame:
    """Memory table without the deleted ids.

    By default the owner is not checked; with ``check_owner`` a row goes only if
    ``deletions`` names its user too.
    """
    keys = ["id", "user_id"] if check_owner else ["id"]
    return memories.join(
        broadcast_if_small(deletions.select(*keys).distinct()), keys, "left_anti"
    )


def delete_users(
    users: DataFrame, memories: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove users and, with them, their memories."""
    gone = broadcast_if_small(deleted.select("user_id").distinct())
    return (
        users.join(gone, "user_id", "left_anti"),
        memories.join(gone, "user_id", "left_anti"),
    )


def plan_sweep(
    memories: DataFrame, as_of: Column, cap: int | None = None, rebase: bool = False
) -> DataFrame:
    """Add ``current_importance`` and ``action`` (forget, update, keep).

    Without ``cap`` this is a projection without any shuffle. With ``cap`` only
    the ``cap`` strongest rows of each user are swept and the others kept. With
    ``rebase`` decay counts from the ``decayed_at`` column of an earlier sweep.
    """
    if rebase and "decayed_at" in memories.columns:
        since = F.coalesce(F.greatest("decayed_at", "last_accessed"), F.col("last_accessed"))
        current = _current_since(as_of, since)
    else:
        current = current_importance(as_of)
    swept = memories.withColumn("current_importance", current)
    action = sweep_action(F.col("importance_score"), F.col("current_importance"))
    if cap is None:
        return swept.withColumn("action", action)
    last_swept = (
        top_k_per_group(
            memories.select("user_id", "id", "importance_score"),
            ["user_id"],
            [F.col("importance_score").desc(), F.col("id")],
            cap,
            split_on="id",
        )
        .filter(F.col("rank") == cap)
        .select(
            "user_id",
            F.col("importance_score").alias("cut_score"),
            F.col("id").alias("cut_id"),
        )
    )
    beyond = (F.col("importance_score") < F.col("cut_score")) | (
        (F.col("importance_score") == F.col("cut_score")) & (F.col("id") > F.col("cut_id"))
    )
    return (
        swept.join(broadcast_if_small(last_swept), "user_id", "left")
        .withColumn("action", F.when(beyond, F.lit("keep")).otherwise(action))
        .drop("cut_score", "cut_id")
    )


def _current_since(as_of: Column, since: Column) -> Column:
    return decayed_importance(
        F.col("importance_score"), F.col("decay_rate"), F.col("access_count"),
        days_since(as_of, since),
    )


def apply_sweep(planned: DataFrame, as_of: Column, rebase: bool = False) -> DataFrame:
    """Drop forgotten rows and write back updated scores.

    The access time is not moved, so a second sweep decays from the lowered
    score again; ``rebase`` records ``decayed_at`` to make sweeps repeatable.
    """
    kept = planned.filter(F.col("action") != "forget")
    updated = F.col("action") == "update"
    result = kept.withColumn(
        "importance_score",
        F.when(updated, F.col("current_importance")).otherwise(F.col("importance_score")),
    )
    if rebase:
        before = F.col("decayed_at") if "decayed_at" in planned.columns else F.lit(None)
        result = result.withColumn(
            "decayed_at", F.when(updated, as_of).otherwise(before.cast("timestamp"))
        )
    return result.drop("action", "current_importance")


def sweep(
    memories: DataFrame, as_of: Column, cap: int | None = None, rebase: bool = False
) -> DataFrame:
    """One decay sweep over all users."""
    return apply_sweep(plan_sweep(memories, as_of, cap, rebase), as_of, rebase)


def forgotten_per_user(planned: DataFrame) -> DataFrame:
    """How many memories a planned sweep removes from each user."""
    return planned.groupBy("user_id").agg(
        F.count_if(F.col("action") == "forget").alias("memories_forgotten")
    )


def forget(
    memories: DataFrame, commands: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Run forget commands (command_id, user_id, memory_id, run_decay) in order of command_id.

    An id wins over the decay flag; a command with neither is an error. Returns
    the next table and one outcome row per command.

    Sweeps compound: the second of a user starts from what the first left, and each reports
    what it forgot itself. A row is moved through all sweeps of its user at once, in
    its own state (:func:`swept_times`), up to the first command that deletes it.
    """
    kind = (
        F.when(F.coalesce("memory_id", F.lit("")) != "", F.lit("delete"))
        .when(F.coalesce("run_decay", F.lit(False)), F.lit("decay"))
        .otherwise(F.lit("error"))
    )
    routed = commands.withColumn("memory_id", F.col("memory_id").cast("string")).withColumn(
        "kind", kind
    )
    deletions = (
        routed.filter(F.col("kind") == "delete")
        # Text that is no id of this table deletes nothing.
        .groupBy(F.col("memory_id").try_cast(memories.schema["id"].dataType).alias("id"))
        .agg(F.min("command_id").alias("command_id"))
        .filter(F.col("id").isNotNull())
    )
    deletions = broadcast_if_small(deletions)
    decays = routed.filter(F.col("kind") == "decay").select("user_id", "command_id")
    # Sweeps and deletions of each user's memories in one order: a sweep's number is one
    # more than the sweeps before it, a deleted row has seen the sweeps before its deletion.
    owned = memories.select("id", "user_id").join(deletions, "id")
    moments = materialised(
        decays.select("user_id", "command_id", F.lit(1).alias("sweep"), F.lit(None).cast(memories.schema["id"].dataType).alias("id"))
        .unionByName(owned.select("user_id", "command_id", F.lit(0).alias("sweep"), "id"))
    )
    numbered = materialised(
        running(moments, ["user_id"], [F.col("command_id"), F.col("sweep")], {"before": F.col("sweep")})
    )
    sweeps = numbered.filter("sweep = 1").select("command_id", "user_id", (F.col("before") + 1).alias("number"))
    until = broadcast_if_small(numbered.filter("sweep = 0").select("id", F.col("before").alias("seen")))
    asked = broadcast_if_small(decays.groupBy("user_id").agg(F.count("*").alias("all")))
    rows = memories.join(asked, "user_id", "left").join(until, "id", "left")
    times = F.coalesce("seen", "all", F.lit(0))
    walked = rows.withColumn("_walk", F.when(times > 0, swept_times(as_of, times)))
    fell = F.coalesce(F.col("_walk")["fell"], F.lit(0))
    counts = broadcast_if_small(
        walked.filter(fell > 0).groupBy("user_id", fell.cast("long").alias("number")).agg(F.count("*").alias("forgotten"))
    )
    told = sweeps.join(counts, ["user_id", "number"], "left").select("command_id", "forgotten")
    outcome = routed.join(broadcast_if_small(told), "command_id", "left").select(
        "command_id",
        "user_id",
        "kind",
        F.when(F.col("kind") == "delete", F.col("memory_id")).alias("memory_id"),
        F.when(F.col("kind") == "decay", F.coalesce("forgotten", F.lit(0))).alias("forgotten_count"),
        F.when(
            F.col("kind") == "error", F.lit("Nothing to do: name a memory or ask for a decay run")
        ).alias("error"),
    )
    left = walked.filter((fell == 0) & F.col("seen").isNull()).withColumn(
        "importance_score", F.coalesce(F.col("_walk")["score"], "importance_score")
    )
    return left.select(*memories.columns), outcome


def swept_times(as_of: Column, times: Column) -> Column:
    """A row after ``times`` sweeps in a row: score, and the number of the sweep it fell in (or 0).

    A sweep that leaves the score alone leaves it alone for good, and each other one moves it
    by more than the write-back step towards an end of 0 to 1, so there are never
    more than about a thousand different steps to take.
    """
    most = int(1 / WRITE_BACK_EPSILON) + 1
    days = days_since(as_of, F.col("last_accessed"))
    start = F.struct(F.col("importance_score").cast("double").alias("score"), F.lit(0).alias("fell"))

    def one(state: Column, number: Column) -> Column:
        score = state["score"]
        after = decayed_importance(score, F.col("decay_rate"), F.col("access_count"), days)
        action = sweep_action(score, after)
        moved = F.struct(
            F.when(action == "update", after).otherwise(score).alias("score"),
            F.when(action == "forget", number).otherwise(F.lit(0)).alias("fell"),
        )
        return F.when(state["fell"] > 0, state).otherwise(moved)

    steps = F.sequence(F.lit(1), F.least(times, F.lit(most)).cast("int"))
    return F.aggregate(steps, start, one)
