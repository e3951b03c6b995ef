"""Mixing sources to target weights by blocks of words.

1. ``pack``: the words of a source, documents in order, form one stream that is cut into
   blocks of fixed length (the last is shorter).
2. ``targets``: weights share the words to take; no source gives more than a stated
   multiple of its own size, and what it leaves is shared by weight among the rest.
3. ``draw``: every output shard draws its number of blocks by source from a multinomial
   distribution. So that a source's total meets its target, the few blocks beyond it are
   handed to sources that are short of theirs.
4. A source's k-th drawn slot takes the block that a pseudorandom permutation of
   its block numbers sends k to, one permutation for each pass over the source,
5. and slots and blocks are joined by block number.

No task holds a whole source. Everything is a function of the rows and ``seed``, so
reruns agree.

Defined results: null and empty texts have size 0 and are never taken; a null source is
a source of its own, the last; rows of one doc_id are ordered by a hash of their text, and
repeated rows each have their own words; an empty table has no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import map_batches
from mnemospark.llm.shingles import mix as spread
from mnemospark.operators.ranking import running
from mnemospark.session import broadcast_if_small, materialised

#: Words of a block; a source's taken words miss its target by half as many at most.
BLOCK = 64

#: Blocks of an output shard.
SHARD = 4_096

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)

#: Words to take, as a share of all words, and the most of a source that is taken.
SHARE, MOST = 1.5, 2.0

#: Sources whose counts are drawn by one task for one shard; more are drawn by groups first.
GROUP = 4_096

#: White space between words, as a pattern.
BLANKS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    empty = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    # A text of blanks alone, or of nothing, has one part or two empty ones.
    return F.greatest(F.size(parts) - empty, F.lit(0)).cast("long")


class Packed(NamedTuple):
    """``docs``: doc_id, text_key (a hash of the text), src, size, at (words of the source before it).

    ``sources``: src (number in order), source, source_size, n_blocks.
    """

    docs: DataFrame
    sources: DataFrame


def pack(docs: DataFrame) -> Packed:
    """Documents placed in the word stream of their source."""
    sized = materialised(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    )
    totals = materialised(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0)))
    sources = materialised(
        running(totals, ["all"], [F.col("source").asc_nulls_last()], {"src": F.lit(1)}).select(
            "src", "source", "source_size", F.ceil(F.col("source_size") / BLOCK).alias("n_blocks")
        )
    )
    named = broadcast_if_small(sources.select("src", F.col("source").alias("named")))
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named", "source")
    order = [F.col("doc_id"), F.col("text_key"), F.col("size")]
    return Packed(materialised(running(materialised(placed), ["src"], order, {"at": F.col("size")})), sources)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` with ``target``: the words to take of each.

    A source's target is the smaller of ``most`` times its size and its weight times a
    level that all share. Every round raises the level by what capped sources leave;
    a source once capped stays so, and the rounds end when no further one is.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src") % len(weights) + 1).cast("int"))
    known = sources.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    wanted = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        state = known.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if state["n"] == capped or not state["open"]:
            break
        capped, level = state["n"], (wanted - state["given"]) / state["open"]
    target = F.least(F.col("cap"), level * F.col("weight"))
    return known.withColumn("target", target).drop("cap")


def _random(seed: int, *keys) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, 0], counter=[0, 0, *keys]))


def draw(sources: DataFrame, seed: int = 0, shard: int = SHARD) -> DataFrame:
    """Slots of the mix: shard, slot, src, k (the slot's number among those of its source).

    ``sources`` needs src, n_blocks, source_size and target. A source gets as many slots
    in all as its target is worth in its blocks.
    """
    spark = sources.sparkSession
    quota = F.round(F.col("target") * F.try_divide("n_blocks", "source_size")).cast("long")
    wanted = materialised(sources.select("src", quota.alias("quota")).where("quota > 0"))
    grouped = materialised(
        wanted.groupBy(F.expr(f"src div {GROUP}L").alias("group"))
        .agg(F.sort_array(F.collect_list(F.struct("src", "quota"))).alias("members"), F.sum("quota").alias("quota"))
    )
    # One number for each 4,096 sources.
    groups = sorted((r["group"], r["quota"]) for r in grouped.select("group", "quota").collect())
    total = sum(q for _, q in groups)
    names = np.array([g for g, _ in groups], np.int64)
    odds = np.array([q for _, q in groups], float) / max(total, 1)

    def by_group(batch: pa.RecordBatch) -> dict:
        shards = batch.column("shard").to_numpy()
        counts = np.array([_random(seed, 0, s).multinomial(min(shard, total - s * shard), odds) for s in shards])
        row, column = np.nonzero(counts)
        return {"shard": shards[row], "group": names[column], "drawn": counts[row, column]}

    def by_source(batch: pa.RecordBatch) -> dict:
        out = {"shard": [], "src": [], "drawn": []}
        members = batch.column("members")
        for row in range(batch.num_rows):
            flat = members[row].values.flatten()
            src, quota = flat[0].to_numpy(), flat[1].to_numpy().astype(float)
            at, group = batch.column("shard")[row].as_py(), batch.column("group")[row].as_py()
            counts = _random(seed, group + 1, at).multinomial(batch.column("drawn")[row].as_py(), quota / quota.sum())
            some = np.flatnonzero(counts)
            out["shard"].append(np.full(len(some), at))
            out["src"].append(src[some])
            out["drawn"].append(counts[some])
        return {k: np.concatenate(v) for k, v in out.items()}

    shards = spark.range(-(-total // shard)).select(F.col("id").alias("shard"))
    first = map_batches(shards, by_group, "shard long, group long, drawn long")
    members = broadcast_if_small(grouped.select("group", "members"), max_rows=16)
    drawn = materialised(map_batches(first.join(members, "group"), by_source, "shard long, src long, drawn long"))

    counted = running(drawn, ["src"], [F.col("shard")], {"before": F.col("drawn")})
    slots = counted.select("shard", "src", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("drawn") - 1)).alias("k"))
    sums = drawn.groupBy("src").agg(F.sum("drawn").alias("drawn"))
    against = materialised(
        wanted.join(sums, "src", "left").select(
            "src", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.lit(0).alias("all"),
            F.greatest(F.coalesce("drawn", F.lit(0)) - F.col("quota"), F.lit(0)).alias("over"),
            F.greatest(F.col("quota") - F.coalesce("drawn", F.lit(0)), F.lit(0)).alias("short"),
        )
    )
    surplus = running(against, ["all"], [F.col("src")], {"over_before": F.col("over")}).select("src", "quota", "over_before")
    missing = running(against, ["all"], [F.col("src")], {"short_before": F.col("short")}).where("short > 0")
    # The j-th slot beyond a quota goes to the j-th that is missing from another.
    handed = missing.select(
        F.explode(F.sequence(F.col("short_before"), F.col("short_before") + F.col("short") - 1)).alias("j"),
        F.col("src").alias("to_src"),
        (F.col("drawn") - F.col("short_before")).alias("shift"),
    )
    known = slots.join(broadcast_if_small(surplus), "src").withColumn(
        "j", F.when(F.col("k") >= F.col("quota"), F.col("over_before") + F.col("k") - F.col("quota"))
    )
    return known.where("j is null").select("shard", "src", "k").unionByName(
        known.where("j is not null")
        .join(broadcast_if_small(handed), "j")
        .select("shard", F.col("to_src").alias("src"), (F.col("j") + F.col("shift")).alias("k"))
    )


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key, at ``index``.

    Feistel rounds permute the least range of 4^b numbers that holds ``size``; numbers
    beyond ``size`` go through again until they are inside.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    # Rounding of the logarithm must not make the range too small.
    half += (np.uint64(1) << (np.uint64(2) * half)) < size.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = out[open_] >> h, out[open_] & m
        for r in range(rounds):
            left, right = right, left ^ (spread(right ^ spread(k + np.uint64(r))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= size[open_].astype(np.uint64)]
    return out.astype(np.int64)


def blocks_of(slots: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """The slots with ``block``, the number of the block in its source that they take."""
    known = slots.join(broadcast_if_small(sources.select("src", "n_blocks")), "src")

    def choose(batch: pa.RecordBatch) -> dict:
        src, k, n = (batch.column(c).to_numpy() for c in ("src", "k", "n_blocks"))
        turn = (k // n).astype(np.uint64)
        key = spread(spread(src.astype(np.uint64) + np.uint64(seed << 32)) + turn)
        return {"shard": batch.column("shard"), "src": src, "k": k, "block": permuted(k % n, n, key)}

    return map_batches(known.select("shard", "src", "k", "n_blocks"), choose, "shard long, src long, k long, block long")


def pieces(docs: DataFrame) -> DataFrame:
    """What each document gives to each block: src, block, doc_id, at, from, to (words of the document)."""
    last = F.expr(f"(at + size - 1) div {BLOCK}L")
    whole = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {BLOCK}L"), last)))
    start = F.col("block") * BLOCK - F.col("at")
    return whole.select(
        "src", "block", "doc_id", "at",
        F.greatest(start, F.lit(0)).alias("from"), F.least(start + BLOCK, F.col("size")).alias("to"),
    )


class Mix(NamedTuple):
    """``docs`` as packed; ``sources`` with weight and target; ``slots``: shard, slot, src, k, block.

    ``taken``: the slots joined with the pieces of their blocks, that is the words
    ``from`` to ``to`` (exclusive, from 0) of the document that starts ``at`` a place of its source.
    """

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    taken: DataFrame


def mix(docs: DataFrame, seed: int = 0, shard: int = SHARD) -> Mix:
    """Mix ``docs`` (doc_id, source, text) to the target weights of their sources.

    Within a shard the slots of all sources are shuffled.
    """
    packed = pack(docs)
    sources = materialised(targets(packed.sources))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("src", "k", F.lit(seed)), "src", "k")
    drawn = blocks_of(draw(sources, seed, shard), sources, seed).withColumn("slot", F.row_number().over(shuffled) - 1)
    slots = materialised(drawn.select("shard", "slot", "src", "k", "block"))
    return Mix(packed.docs, sources, slots, slots.join(pieces(packed.docs), ["src", "block"]))


def words_taken(mixed: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    taken = mixed.taken.groupBy("src", "at").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    some = mixed.docs.where("size > 0").join(taken, ["src", "at"], "left")
    none = mixed.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    rates = broadcast_if_small(mixed.sources.select("src", "source_size", "target"))
    known = some.unionByName(none).join(rates, "src")
    return known.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix itself: shard, slot, src and the words of the slot's block, one blank between words.

    Texts are cut into their pieces once; then only pieces are shuffled.
    """
    named = broadcast_if_small(mixed.sources.select("src", F.col("source").alias("named")))
    texts = (
        docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"))
        .join(named, F.col("source").eqNullSafe(F.col("named")))
        .dropDuplicates(["doc_id", "src", "text_key"])
        .select(F.col("doc_id").alias("id"), F.col("src").alias("s"), "text", F.col("text_key").alias("key"))
    )
    same = (F.col("id").eqNullSafe(F.col("doc_id"))) & (F.col("s") == F.col("src")) & (F.col("key") == F.col("text_key"))
    words = F.filter(F.split("text", BLANKS), lambda word: word != "")
    first, last = F.expr(f"at div {BLOCK}L"), F.expr(f"(at + size - 1) div {BLOCK}L")

    def piece(block: Column) -> Column:
        start = F.greatest(block * BLOCK - F.col("at"), F.lit(0))
        stop = F.least((block + 1) * BLOCK - F.col("at"), F.col("size"))
        part = F.slice(F.col("words"), (start + 1).cast("int"), (stop - start).cast("int"))
        return F.struct(block.alias("block"), F.array_join(part, " ").alias("part"))

    cut = (
        mixed.docs.where("size > 0")
        .join(texts, same)
        .withColumn("words", words)
        .select("src", "at", F.explode(F.transform(F.sequence(first, last), piece)).alias("cut"))
        .select("src", "at", "cut.*")
    )
    filled = mixed.slots.join(cut, ["src", "block"]).groupBy("shard", "slot", "src")
    return filled.agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "part")))["part"], " ").alias("text"))
