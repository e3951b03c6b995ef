"""Short text and score expressions used by reports and packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.schema import CHART_LABEL_CHARS, CHARS_PER_TOKEN


def token_cost(content: Column) -> Column:
    """About four characters per token, rounded down."""
    return F.floor(F.length(content) / F.lit(CHARS_PER_TOKEN)).cast("int")


def search_score(rerank: Column, similarity: Column, importance: Column) -> Column:
    """Ranking score; a rerank score of zero gives way to the similarity."""
    return F.coalesce(F.nullif(rerank, F.lit(0.0)), similarity) * importance


def pack_score(rerank: Column, similarity: Column, importance: Column) -> Column:
    """Packing score; only a missing rerank score gives way to the similarity."""
    return F.coalesce(rerank, similarity) * importance


def chart_label(content: Column) -> Column:
    """First characters of the content (code points), with an ellipsis if cut."""
    return F.when(
        F.length(content) > CHART_LABEL_CHARS,
        F.concat(F.substring(content, 1, CHART_LABEL_CHARS), F.lit("…")),
    ).otherwise(content)


def percent(importance: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(importance * 100 + 0.5).cast("int")


def average_text(average: Column) -> Column:
    """Average with two decimals, a dash when there is none."""
    return F.when(average.isNotNull(), F.format_string("%.2f", average)).otherwise(F.lit("—"))


def memory_line(position: Column, memory_type: Column, content: Column) -> Column:
    """``1. [type] content``"""
    return F.concat(
        position.cast("string"), F.lit(". ["), memory_type, F.lit("] "), content
    )
