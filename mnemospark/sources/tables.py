"""Reading and writing the memory and user tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.vector import format_vector, parse_vector
from mnemospark.schema import MEMORY_SCHEMA, USER_SCHEMA, public_view


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memory table with its declared schema; no inference pass over the files."""
    return spark.read.schema(MEMORY_SCHEMA).parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER_SCHEMA).parquet(path)


def scan_public(spark: SparkSession, path: str) -> DataFrame:
    """Public columns only, so the scan never touches the vectors."""
    return public_view(read_memories(spark, path))


def write_memories(memories: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table version sorted by user inside each file.

    Rows stay in the tasks that made them (no exchange, so a large user is no
    hot spot); the sort lets row-group statistics skip other users.
    """
    memories.sortWithinPartitions("user_id", F.col("importance_score").desc()).write.mode(
        mode
    ).parquet(path)


def append_memories(rows: DataFrame, path: str) -> None:
    write_memories(rows, path, mode="append")


def import_vector_text(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Replace ``[v1,v2,...]`` text by an array column."""
    return rows.withColumn(column, parse_vector(F.col(column)))


def export_vector_text(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, format_vector(F.col(column)))
