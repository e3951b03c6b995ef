"""A memory table in two halves: texts and vectors, written once, and the state that changes.

``vectors`` holds the wide columns, ``state`` the narrow ones that recalls, sweeps and updates
change. Both lie in the same number of buckets by id, so they are joined where they
are, and a change of state moves neither: only what is to be applied (recalls, scores, deleted
ids) is shuffled to the buckets. A new version of the state is written beside the old one and
becomes the current one by its mark in ``versions``, the last thing written; vectors
of deleted memories stay until :func:`create` writes the table anew.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.lifecycle import after_recalls, roll_up_accesses

#: Columns that never change, and are wide.
WIDE = ("content", "summary", "embedding", "metadata")


class Split(NamedTuple):
    """A split table at one version of its state."""

    spark: SparkSession
    path: str
    buckets: int
    version: int

    @property
    def state(self) -> DataFrame:
        """Narrow columns of all memories."""
        return _opened(self, f"{self.path}/state/version={self.version}")

    @property
    def vectors(self) -> DataFrame:
        """id and the wide columns of all memories, deleted ones included."""
        return _opened(self, f"{self.path}/vectors")

    def memories(self) -> DataFrame:
        """Whole rows; neither side is shuffled."""
        return self.state.join(self.vectors.hint("merge"), "id")


def create(memories: DataFrame, path: str, buckets: int = 64) -> Split:
    """Write a table in two halves."""
    wide = [c for c in WIDE if c in memories.columns]
    table = Split(memories.sparkSession, path, buckets, 0)
    dealt = memories.repartition(buckets, "id")
    _write(table, dealt.select("id", *wide), f"{path}/vectors")
    _write(table, dealt.drop(*wide), f"{path}/state/version=0")
    _mark(table)
    return table


def current(spark: SparkSession, path: str) -> Split:
    """The table at its latest version."""
    marks = spark.read.schema("buckets int, version int").parquet(f"{path}/versions")
    latest = marks.agg(F.max(F.struct("version", "buckets")).alias("m")).first()["m"]
    return Split(spark, path, latest["buckets"], latest["version"])


def reinforce(table: Split, log: DataFrame, boost: bool = True) -> Split:
    """Boost the recalled memories (or, without ``boost``, track their accesses alone)."""
    state = table.state
    recalled = state.join(roll_up_accesses(log).hint("merge"), "id", "left")
    return _next(table, after_recalls(recalled, state, boost))


def set_importance(table: Split, scores: DataFrame) -> Split:
    """Set the stored score of the ids in ``scores`` (id, new_score; one row each)."""
    state = table.state
    joined = state.join(scores.select("id", "new_score").hint("merge"), "id", "left")
    score = F.coalesce("new_score", "importance_score")
    return _next(table, joined.withColumn("importance_score", score).select(*state.columns))


def delete(table: Split, deletions: DataFrame, check_owner: bool = False) -> Split:
    """Drop the ids in ``deletions`` from the state; with ``check_owner`` only those of the named user."""
    state = table.state
    named = deletions.select("id", F.col("user_id").alias("owner") if check_owner else F.lit(None).alias("owner"))
    rule = state["id"] == named["id"]
    if check_owner:
        rule = rule & (state["user_id"] == named["owner"])
    return _next(table, state.join(named.hint("merge"), rule, "left_anti"))


def insert(table: Split, rows: DataFrame) -> Split:
    """Add new memories: their wide columns to the vectors, the rest to the state."""
    state, vectors = table.state, table.vectors
    fresh = rows.repartition(table.buckets, "id")
    _write(table, _as(fresh, vectors), f"{table.path}/vectors", "append")
    return _next(table, state.unionByName(_as(fresh, state)).repartition(table.buckets, "id"))


def _as(rows: DataFrame, like: DataFrame) -> DataFrame:
    held = {f.name: f.dataType for f in like.schema}
    return rows.select(
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in held.items()]
    )


def _next(table: Split, state: DataFrame) -> Split:
    after = table._replace(version=table.version + 1)
    _write(after, state, f"{table.path}/state/version={after.version}")
    _mark(after)
    return after


def _mark(table: Split) -> None:
    row = table.spark.createDataFrame([(table.buckets,)], "buckets int").coalesce(1)
    row.write.mode("overwrite").parquet(f"{table.path}/versions/version={table.version}")


def _write(table: Split, rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows that lie by buckets already are written as they are, one file for each bucket."""
    name = f"split_{uuid.uuid4().hex}"
    if mode == "append":
        _register(table, name, rows.schema.toDDL(), path)
        rows.select(*table.spark.table(name).columns).write.mode("append").insertInto(name)
    else:
        rows.write.option("path", path).bucketBy(table.buckets, "id").sortBy("id").saveAsTable(name)
    table.spark.sql(f"DROP TABLE {name}")


def _opened(table: Split, path: str) -> DataFrame:
    """The bucketed files of a path; their layout is told to this session's catalog by a name of its own."""
    columns = table.spark.read.parquet(path).schema.toDDL()
    name = f"split_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    if table.spark.catalog.tableExists(name):
        table.spark.catalog.refreshTable(name)
    else:
        _register(table, name, columns, path)
    return table.spark.table(name)


def _register(table: Split, name: str, columns: str, path: str) -> None:
    table.spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY (id) SORTED BY (id) INTO {table.buckets} BUCKETS LOCATION '{path}'"
    )
