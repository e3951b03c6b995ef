"""Greedy packing of search results under a token budget, and the context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import memory_line, pack_score, token_cost
from mnemospark.schema import CONTEXT_TOKENS

OPENING = (
    "You are a coding assistant that keeps what it learned in earlier sessions "
    "and uses it to answer better.\n\n"
)
SECTION_HEAD = "## Remembered from earlier sessions\n"
SECTION_TAIL = "\n\nLet these memories shape the answer and mention them where they matter.\n"
CLOSING = "\nBe brief and technical, and do not ask again for what is already remembered."


def pack_memories(results: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Per request the memories that fit, as ``qid, selected, tokens_used``.

    ``selected`` is an array of (position, id, memory_type, content, cost) in
    packing order. A memory that does not fit is passed over and the walk goes
    on. The fold runs over one candidate pool per request at most, which search
    bounds, so the array never grows with the data.
    """
    entry = F.struct(
        (-F.col("pack_score")).alias("descending"),
        F.col("rank").alias("rank"),
        F.col("id"),
        F.col("memory_type"),
        F.col("content"),
        F.col("cost"),
    )
    ordered = (
        results.withColumn(
            "pack_score",
            pack_score(F.col("rerank_score"), F.col("similarity"), F.col("importance_score")),
        )
        .withColumn("cost", token_cost(F.col("content")))
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    )
    types = {f.name: f.dataType.simpleString() for f in results.schema}
    taken = f"array<struct<id:{types['id']},memory_type:string,content:string,cost:int>>"
    start = F.struct(F.lit(budget).alias("left"), F.array().cast(taken).alias("taken"))

    def take(state: Column, item: Column) -> Column:
        fits = item["cost"] <= state["left"]
        row = F.struct(*(item[c].alias(c) for c in ("id", "memory_type", "content", "cost")))
        return F.struct(
            F.when(fits, state["left"] - item["cost"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["taken"], F.array(row)))
            .otherwise(state["taken"])
            .alias("taken"),
        )

    folded = ordered.select("qid", F.aggregate("entries", start, take).alias("state"))
    numbered = F.transform(
        "state.taken",
        lambda e, i: F.struct(
            (i + 1).alias("position"),
            *(e[c].alias(c) for c in ("id", "memory_type", "content", "cost")),
        ),
    )
    return folded.select(
        "qid",
        numbered.alias("selected"),
        (F.lit(budget) - F.col("state.left")).alias("tokens_used"),
    )


def selected_rows(packed: DataFrame) -> DataFrame:
    """Packed memories in long form: one row per request and position."""
    # The outer form keeps Spark from computing the fold once more for a filter
    # on empty arrays; they give one row of NULLs instead.
    rows = packed.select("qid", F.inline_outer("selected"))
    return rows.filter(F.col("position").isNotNull())


def oversize_memories(memories: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Memories that can never be packed because they exceed the whole budget."""
    cost = token_cost(F.col("content"))
    return memories.select("id", "user_id", cost.alias("cost")).filter(F.col("cost") > budget)


def memory_section(selected: Column) -> Column:
    """Numbered memory lines; empty text for an empty or missing selection."""
    lines = F.transform(
        selected, lambda m: memory_line(m["position"], m["memory_type"], m["content"])
    )
    return F.coalesce(F.concat_ws("\n", lines), F.lit(""))


def context_text(section: Column) -> Column:
    """Opening, the memory section only where there is one, closing."""
    middle = F.when(
        section != "", F.concat(F.lit(SECTION_HEAD), section, F.lit(SECTION_TAIL))
    ).otherwise(F.lit(""))
    return F.concat(F.lit(OPENING), middle, F.lit(CLOSING))
