"""From conversations to extraction requests, and from completions to memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.schema import (
    DEFAULT_IMPORTANCE,
    DEFAULT_TYPE,
    EXTRACTION_CAP,
    MEMORY_TYPES,
    rejection_reason,
)

INSTRUCTION = (
    "Below is a transcript. Which statements in it would still help someone who meets this "
    "user next month? Write each as one sentence that is clear without the transcript; pass "
    "over greetings, thanks and anything that only matters right now.\n"
    "Give every statement one label. preference: what the user likes or avoids. decision: a "
    "choice that was made and binds later work. bug_fix: what went wrong and what repaired it. "
    "pattern: a way of doing things worth repeating. general: whatever fits none of these.\n"
    "Reply with a bare JSON array, five entries at the most, each of this form:\n"
    '[{"content": "...", "memory_type": "...", "importance_score": 0.0 to 1.0}]\n'
    "The score says how much would be lost by forgetting the statement: near 1 if work would "
    "break, near 0 if nobody would notice. With nothing worth keeping, reply []."
)
CONVERSATION_HEAD = "Transcript:\n\n"
#: Turns that are put together at once; a conversation is then made of such parts.
PART_TURNS = 512


def conversation_line(role: Column, text: Column) -> Column:
    """``ROLE: text``"""
    return F.concat(F.upper(role), F.lit(": "), text)


def render_conversations(
    turns: DataFrame, roles: Sequence[str] | None = None, part_turns: int | None = None
) -> DataFrame:
    """Texts of the conversations: conv_id, n_turns, conversation; the lines in turn order.

    A conversation is one row, put together from parts in two steps, so that
    no task sorts all its turns at once. Only a caller that passes ``part_turns``
    gets those parts as rows of their own, with their number in ``part``.
    """
    if roles is not None:
        turns = turns.filter(F.col("role").isin(*roles))
    line = F.struct("turn", conversation_line(F.col("role"), F.col("text")).alias("line"))
    part = F.floor(F.col("turn") / F.lit(part_turns or PART_TURNS)).alias("part")
    parts = turns.groupBy("conv_id", part).agg(
        F.count("*").alias("n_turns"),
        F.concat_ws(
            "\n", F.transform(F.sort_array(F.collect_list(line)), lambda t: t["line"])
        ).alias("conversation"),
        F.count(conversation_line(F.col("role"), F.col("text"))).alias("lines"),
    )
    if part_turns is not None:
        return parts.drop("lines")
    # A part without any line must not leave an empty one.
    kept = F.struct("part", F.when(F.col("lines") > 0, F.col("conversation")).alias("text"))
    return parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.concat_ws(
            "\n", F.transform(F.sort_array(F.collect_list(kept)), lambda p: p["text"])
        ).alias("conversation"),
    )


def extraction_prompt(conversation: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION), F.lit("\n\n" + CONVERSATION_HEAD), conversation)


def extraction_requests(turns: DataFrame, per: str = "turn") -> DataFrame:
    """Requests to the extracting model: conv_id, turn (of a message), prompt.

    ``per="turn"`` asks about every user message by itself, as the chat loop
    does (a map without a shuffle); ``per="conversation"`` about whole
    conversations. A conversation without turns gives no request.
    """
    if per == "conversation":
        return render_conversations(turns).select(
            "conv_id", extraction_prompt(F.col("conversation")).alias("prompt")
        )
    line = conversation_line(F.col("role"), F.col("text"))
    return turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", extraction_prompt(line).alias("prompt")
    )


def strip_fence(raw: Column) -> Column:
    """Trim and, if the text opens with a code fence, take what the fence holds."""
    trimmed = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    inside = F.regexp_replace(F.split_part(trimmed, F.lit("```"), F.lit(2)), "^json", "")
    return F.when(trimmed.startswith("```"), inside).otherwise(trimmed)


def with_strict_json(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the variant of a text column that is one JSON value and nothing else.

    Spark's parser stops after the first value. Wrapped in an array with a
    marker behind it, a text with something after its value no longer parses to
    exactly two elements of which the last is the marker. NULL if it does not
    parse.
    """
    # Columns used more than once stay in projections of their own, so that no
    # step is computed again for each use.
    marked = rows.withColumn("_marker", F.md5(F.col(text).cast("binary")))
    wrapped = marked.withColumn(
        "_parts",
        F.try_variant_get(
            F.try_parse_json(
                F.concat(F.lit("["), F.col(text), F.lit(',"'), F.col("_marker"), F.lit('"]'))
            ),
            "$",
            "array<variant>",
        ),
    )
    closing = F.try_variant_get(F.get("_parts", F.lit(1)), "$", "string")
    whole = (F.size("_parts") == 2) & (closing == F.col("_marker"))
    return wrapped.withColumn(name, F.when(whole, F.get("_parts", F.lit(0)))).drop(
        "_marker", "_parts"
    )


def _kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ... of a variant; NULL if it is missing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _number_of(value: Column, kind: Column) -> Column:
    """A JSON number, boolean or numeric text as double; NULL if not numeric."""
    text = F.try_variant_get(value, "$", "string")
    # Fixed format: the decimal numerals a text may hold.
    numeral = r"^\s*[+-]?(\d+(_\d+)*)?(\.(\d+(_\d+)*)?)?([eE][+-]?\d+(_\d+)*)?\s*$"
    from_text = F.when(
        text.rlike(numeral) & text.rlike(r"\d"),
        F.regexp_replace(F.trim(text), "_", "").try_cast("double"),
    )
    return (
        F.when(kind == "STRING", from_text)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").try_cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )


def _text_of(value: Column, kind: Column, null_text: str | None) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "VOID", F.lit(null_text))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.isin("OBJECT", "ARRAY"), F.to_json(value))
        .otherwise(text)
    )


def _judged(items: Column, null_content: str | None) -> Column:
    """Array of items to an array of (item_no, content, type, importance, verdicts)."""

    def read(item: Column) -> Column:
        def field(name: str) -> Column:
            # A path into anything but an object gives NULL.
            return F.try_variant_get(item, f"$.{name}", "variant")

        content, kind, score = field("content"), field("memory_type"), field("importance_score")
        return F.struct(
            (_kind(item) == "OBJECT").alias("is_object"),
            content.alias("content"),
            _kind(content).alias("k_content"),
            kind.alias("kind"),
            _kind(kind).alias("k_kind"),
            score.alias("score"),
            _kind(score).alias("k_score"),
        )

    def typed(v: Column) -> Column:
        memory_type = F.when(v["k_kind"].isNull(), F.lit(DEFAULT_TYPE)).when(
            v["k_kind"] == "STRING", F.try_variant_get(v["kind"], "$", "string")
        )
        score = F.when(v["k_score"].isNull(), F.lit(DEFAULT_IMPORTANCE)).otherwise(
            _number_of(v["score"], v["k_score"])
        )
        return F.struct(
            v["is_object"].alias("is_object"),
            v["k_content"].alias("k_content"),
            v["k_score"].alias("k_score"),
            _text_of(v["content"], v["k_content"], null_content).alias("content"),
            memory_type.alias("memory_type"),
            score.alias("importance_score"),
        )

    def verdict(v: Column, position: Column) -> Column:
        known_type = F.coalesce(v["memory_type"].isin(*MEMORY_TYPES), F.lit(False))
        reaches_score = v["is_object"] & known_type & v["k_content"].isNotNull()
        unreadable = F.coalesce(v["k_score"].isin("VOID", "ARRAY", "OBJECT"), F.lit(False))
        return F.struct(
            position.alias("item_no"),
            v["content"].alias("content"),
            v["memory_type"].alias("memory_type"),
            v["importance_score"].alias("importance_score"),
            rejection_reason(v["content"], v["memory_type"], v["importance_score"]).alias(
                "rejected_because"
            ),
            (~v["is_object"] | (reaches_score & unreadable)).alias("fatal"),
        )

    return F.transform(F.transform(F.transform(items, read), typed), verdict)


def judge_completions(
    completions: DataFrame,
    cap: int = EXTRACTION_CAP,
    null_content: str | None = "None",
) -> DataFrame:
    """Add ``items``, the considered items of each raw completion with verdicts.

    ``completions`` has a ``raw`` column. Each item carries content, memory_type,
    importance_score, ``rejected_because`` (NULL for a good item) and ``fatal``:
    an item that is no object, or whose importance is null, an array or an
    object, spoils its completion. Only the first ``cap`` items count, good or
    bad. ``items`` is NULL when the text is not a JSON list. A null content
    becomes the text ``null_content`` (None rejects the item).
    """
    bare = completions.withColumn("_body", strip_fence(F.col("raw")))
    parsed = with_strict_json(bare, "_body", "parsed").drop("_body")
    considered = F.when(
        _kind(F.col("parsed")) == "ARRAY",
        F.slice(F.try_variant_get(F.col("parsed"), "$", "array<variant>"), 1, cap),
    )
    return parsed.withColumn("items", _judged(considered, null_content)).drop("parsed")


def parse_completions(completions: DataFrame, **options) -> DataFrame:
    """One row per memory found in a table of raw completions.

    The verdicts on one completion are folded inside its row, so the job is a
    map without a shuffle.
    """
    judged = judge_completions(completions, **options)
    sound = F.filter("items", lambda i: i["rejected_because"].isNull())
    kept = F.when(~F.exists("items", lambda i: i["fatal"]), sound)
    others = [c for c in completions.columns if c != "raw"]
    return judged.select(*others, F.inline(kept)).drop("rejected_because", "fatal")


def rejected_items(completions: DataFrame, **options) -> DataFrame:
    """Considered items that were skipped, with the reason; fatal ones marked."""
    judged = judge_completions(completions, **options)
    others = [c for c in completions.columns if c != "raw"]
    skipped = F.filter("items", lambda i: i["rejected_because"].isNotNull() | i["fatal"])
    return judged.select(*others, F.inline(skipped)).select(
        *others, "item_no", "rejected_because", "fatal"
    )
