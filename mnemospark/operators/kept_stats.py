"""Statistics per user and type that are kept up to date by what a batch changed.

``sums`` has one row per user and type: n, importance (exact decimal), risky, and the ends up to
which the extremes are known. ``ends`` holds for each of them the first and the last
few creation times with their numbers of rows. Both only need the rows a batch takes
away and the rows it brings (a changed row is both), however large the table is.

A time beyond the known ends is not kept. When deletions have used up the known times of a
group that still has rows, its times are read from the table once more, and only its.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.ranking import top_k_per_group
from mnemospark.schema import AT_RISK_THRESHOLD
from mnemospark.session import broadcast_if_small, materialised

#: Different creation times that are kept at either end of a group.
KEPT = 8

GROUP = ["user_id", "memory_type"]
EXACT = "decimal(38,18)"


class KeptStats(NamedTuple):
    sums: DataFrame
    ends: DataFrame


def _sums(rows: DataFrame) -> DataFrame:
    weight = F.col("weight")
    score = F.col("importance_score")
    # Decimals add up exactly, so what a batch takes away leaves no trace.
    exact = score.cast(EXACT)
    return rows.groupBy(*GROUP).agg(
        F.sum(weight).alias("n"),
        F.sum(F.when(weight < 0, -exact).otherwise(exact)).cast(EXACT).alias("importance"),
        F.sum(F.when(score < AT_RISK_THRESHOLD, weight).otherwise(0)).alias("risky"),
    )


def _moments(rows: DataFrame) -> DataFrame:
    """Rows by group and creation time; the sign puts the latest times first on their side."""
    times = rows.withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    return (
        times.groupBy(*GROUP, "at")
        .agg(F.sum("weight").alias("rows"))
        .withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
        .withColumn("at", F.col("at") * F.col("side"))
    )


def _named(rows: DataFrame) -> DataFrame:
    """A null type is a type of its own; joins need a name for it."""
    return rows.withColumn("memory_type", F.coalesce("memory_type", F.lit("")))


def start(memories: DataFrame, kept: int = KEPT) -> KeptStats:
    """Statistics of a whole table."""
    return _settled(*_of_table(memories, kept))


def _of_table(memories: DataFrame, kept: int) -> tuple[DataFrame, DataFrame]:
    rows = _named(memories.select(*GROUP, "importance_score", "created_at")).withColumn("weight", F.lit(1))
    return _sums(rows), _kept_ends(_moments(rows), kept)


def _kept_ends(moments: DataFrame, kept: int) -> DataFrame:
    """Times with their rank; the one after the last kept shows that there are more, and is left out."""
    first = top_k_per_group(moments, [*GROUP, "side"], [F.col("at")], kept + 1, split_on="at")
    ranked = first.withColumn("more", F.col("rank") > kept)
    return ranked.select(*GROUP, "side", "at", "rows", "more")


def _settled(sums: DataFrame, ends: DataFrame) -> KeptStats:
    return KeptStats(materialised(sums), materialised(ends))


def update(
    stats: KeptStats, removed: DataFrame | None, added: DataFrame | None, after: DataFrame, kept: int = KEPT
) -> KeptStats:
    """Statistics after a batch.

    ``removed`` are rows as they were, ``added`` rows as they are now (user_id, memory_type,
    importance_score, created_at); ``after`` is the whole table after the batch, of which
    only groups are read whose known times are used up.
    """
    parts = [
        _named(rows.select(*GROUP, "importance_score", "created_at")).withColumn("weight", F.lit(weight))
        for rows, weight in ((removed, -1), (added, 1))
        if rows is not None
    ]
    changed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    changed = materialised(changed)
    sums = (
        stats.sums.unionByName(_sums(changed))
        .groupBy(*GROUP)
        .agg(*[F.sum(c).cast(EXACT if c == "importance" else "long").alias(c) for c in ("n", "importance", "risky")])
        .filter("n > 0")
    )
    sums = materialised(sums)
    # Beyond the last time that is known to be complete nothing can be told.
    limits = stats.ends.groupBy(*GROUP, "side").agg(F.min(F.when(F.col("more"), F.col("at"))).alias("limit"))
    known = stats.ends.filter("not more").select(*GROUP, "side", "at", "rows")
    merged = (
        known.unionByName(_moments(changed))
        .groupBy(*GROUP, "side", "at")
        .agg(F.sum("rows").alias("rows"))
        .join(limits, [*GROUP, "side"], "left")
        .filter((F.col("rows") > 0) & (F.col("limit").isNull() | (F.col("at") < F.col("limit"))))
    )
    bounds = stats.ends.filter("more").join(sums.select(*GROUP), GROUP, "left_semi")
    ends = _kept_ends(merged.select(*GROUP, "side", "at", "rows"), kept)
    # A limit holds on unless this batch found an earlier one.
    found = ends.filter("more").select(*GROUP, "side")
    ends = materialised(ends.unionByName(bounds.join(found, [*GROUP, "side"], "left_anti")))
    alive = ends.filter("not more").groupBy(*GROUP).agg(F.countDistinct("side").alias("sides")).filter("sides = 2")
    worn = sums.select(*GROUP).join(alive, GROUP, "left_anti")
    worn = broadcast_if_small(worn)
    if worn.isEmpty():
        return KeptStats(sums, ends)
    rows = _named(after.select(*GROUP, "importance_score", "created_at")).join(worn, GROUP, "left_semi")
    anew = _kept_ends(_moments(rows.withColumn("weight", F.lit(1))), kept)
    return KeptStats(sums, materialised(ends.join(worn, GROUP, "left_anti").unionByName(anew)))


def user_stats(stats: KeptStats) -> DataFrame:
    """The columns of :func:`reports.full_stats`, from one row per user and type."""
    first = stats.ends.filter("not more").groupBy(*GROUP, "side").agg(F.min("at").alias("at"))
    times = first.groupBy("user_id").agg(
        _time(F.min(F.when(F.col("side") == 1, F.col("at")))).alias("oldest_memory"),
        _time(-F.min(F.when(F.col("side") == -1, F.col("at")))).alias("newest_memory"),
    )
    entry = F.struct(F.nullif("memory_type", F.lit("")).alias("memory_type"), "n")
    whole = stats.sums.groupBy("user_id").agg(
        F.sum("n").alias("total_memories"),
        (F.sum("importance").cast("double") / F.sum("n")).alias("avg_importance"),
        F.sum("risky").alias("memories_at_risk"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("memory_type") != "", entry)))).alias("memories_by_type"),
    )
    return whole.join(times, "user_id", "left")


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros)
