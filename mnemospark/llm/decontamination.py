"""Benchmark windows inside documents, by a prefix-filtered set join.

A window is 13 consecutive words of an item (all words of a shorter item), seen
as the set of its three-word shingles with their places. To contain a window a
text must hold *all* its shingles, so a prefix of one shingle is enough to find
every candidate; the rarest in the documents is taken. A match of that shingle
fixes the place of the window; the length bound drops places that overrun the
text, and the words there are compared one by one.

Documents are read twice, once for shingles and once for word counts; what is
shuffled are only matches of benchmark shingles. DataFrame functions throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, materialised

WINDOW = 13
SHINGLE = 3

#: A document is contaminated from this share of hit words (1 in 20).
SHARE = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), NO_WORD), "")


def n_words(text: Column) -> Column:
    """Number of words; case plays no part in it."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), ""))


def _shingles(tokens: str, width: int) -> Column:
    """Hashes of all shingles of one width, by place."""
    parts = ", ".join(f"{tokens}[i + {k}]" for k in range(width))
    last = f"size({tokens}) - {width}"
    return F.expr(
        f"if({last} < 0, cast(array() as array<bigint>), "
        f"transform(sequence(0, greatest({last}, 0)), i -> xxhash64({width}, {parts})))"
    )


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and words of each distinct window of each item."""
    tokens = items.select("item_id", words(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    cut = F.expr(f"transform(sequence(0, greatest(size(tokens) - {window}, 0)), i -> slice(tokens, i + 1, {window}))")
    return tokens.select("item_id", F.explode(cut).alias("window")).distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, item_id, start, length of each occurrence of a window.

    text_key is a 64-bit hash of the text; it tells rows of one doc_id apart.
    """
    cut = materialised(windows(items, window).withColumn("width", F.least(F.lit(SHINGLE), F.size("window"))))
    widths = [r["width"] for r in cut.select("width").distinct().collect()] or [SHINGLE]
    placed = reduce(
        DataFrame.unionByName,
        [
            cut.where(F.col("width") == w).select("item_id", "window", F.posexplode(_shingles("window", w)).alias("offset", "shingle"))
            for w in widths
        ],
    )
    tokens = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("tokens")
    )
    # Items of one or two words, if there are any, need shingles of their own width.
    found = reduce(
        DataFrame.unionByName,
        # Hashes first, then the explosion of a plain column, which is compiled. "Outer", since
        # Spark else infers a filter that would split the text once for each shingle.
        [
            tokens.withColumn("hashed", _shingles("tokens", w)).select(
                "doc_id", "text_key", "tokens", F.posexplode_outer("hashed").alias("at", "shingle")
            )
            for w in widths
        ],
    )
    known = broadcast_if_small(placed.select("shingle").distinct())
    # The words that any window with this shingle could cover, and where they begin.
    begin = F.greatest(F.col("at") - window + 1, F.lit(0))
    matches = materialised(
        found.join(known, "shingle").select(
            "doc_id", "text_key", "at", "shingle", begin.alias("begin"),
            F.slice("tokens", begin + 1, F.lit(2 * window)).alias("near"),
        )
    )
    rarity = matches.groupBy("shingle").count()
    # One necessary shingle of each window; a window with one that no text has cannot occur.
    prefix = (
        placed.join(rarity, "shingle", "left")
        .groupBy("item_id", "window")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
        .where("rarest.n > 0")
        .select("item_id", "window", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    )
    first = F.col("at") - F.col("offset") - F.col("begin")
    return (
        matches.join(broadcast_if_small(prefix), "shingle")
        .where((first >= 0) & (first + F.size("window") <= F.size("near")))
        .where(F.slice("near", first + 1, F.size("window")) == F.col("window"))
        .select("doc_id", "text_key", "item_id", (F.col("at") - F.col("offset")).alias("start"), F.size("window").alias("length"))
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items (sorted ids, comma-joined), contaminated.

    One row for each row in, repeated ones repeated; a null or wordless text has
    no words and no hits; null items and items without words have no windows; an item
    with a null id is hit, but not counted or named. An
    empty benchmark or documents table gives no hits.
    """
    found = materialised(hits(docs, items, window))
    at = found.select("doc_id", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
    hit = at.distinct().groupBy("doc_id", "text_key").agg(F.count("at").alias("n_hit"))
    named = (
        found.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id", "text_key")
        .agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).cast("long").alias("n_words"))
    both = hit.alias("h").join(
        named.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.text_key") == F.col("i.text_key"))
    ).select("h.doc_id", "h.text_key", "n_hit", "n_items", "items")
    joined = rows.alias("d").join(
        broadcast_if_small(both).alias("h"),
        F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")),
        "left",
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "d.doc_id",
        "d.text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
