"""Groups of near copies from band buckets, without making all pairs of a bucket.

Members of a bucket are first compared with one hub of the bucket. Links merge
members into components, and a pair inside a component needs no comparison.
What is then left are pairs of members of one bucket that lie in different
components; those that exact bounds do not rule out are compared as well, so
that no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import map_batches
from mnemospark.llm.components import components
from mnemospark.session import materialised

#: Similarity from which two sets are linked, in hundredths.
THRESHOLD = 80

#: Words of 64 bits that tell what a set lacks of its hub's shingles, and as many for what it has besides.
WORDS = 8
LACKS, BESIDES = [f"lacks{k}" for k in range(WORDS)], [f"besides{k}" for k in range(WORDS)]


def shared_buckets(bands: DataFrame) -> DataFrame:
    """The rows (key, id, n) of buckets with two members or more; ids are distinct in a bucket."""
    order = Window.partitionBy("key").orderBy("id")
    sides = bands.withColumn("before", F.lag("id").over(order)).withColumn("after", F.lead("id").over(order))
    return sides.where("before is not null or after is not null").select("key", "id", "n")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, common of pairs (u, v): how many shingles their full sets share."""

    def run(batch: pa.RecordBatch) -> dict:
        common = [
            len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())
        ]
        return {"u": batch["u"], "v": batch["v"], "common": common}

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v"
    )
    return map_batches(both.select("u", "v", "a", "b"), run, "u long, v long, common long")


def _slots(shingles: np.ndarray) -> np.ndarray:
    """One bit for each slot that a shingle falls into."""
    taken = np.zeros(64 * WORDS, bool)
    taken[shingles % np.uint64(len(taken))] = True
    return np.packbits(taken).view(np.int64)


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, common of pairs (u, v), and the slots of what u lacks of v and has besides v."""

    def run(batch: pa.RecordBatch) -> dict:
        common, rows = [], []
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            lacks, besides = np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)
            common.append(len(b) - len(lacks))
            rows.append(np.concatenate([_slots(lacks), _slots(besides)]))
        return {"u": batch["u"], "v": batch["v"], "common": common} | dict(zip(LACKS + BESIDES, np.stack(rows, axis=1)))

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v"
    )
    slots = "".join(f", {c} long" for c in LACKS + BESIDES)
    return map_batches(both.select("u", "v", "a", "b"), run, f"u long, v long, common long{slots}")


def own_shingles(sets: DataFrame) -> DataFrame:
    """id, own: how many shingles of a set no other set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
            if found:
                sizes = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch["id"].to_numpy(), sizes)), pa.array(np.concatenate(found))], names=["id", "x"]
                )

    flat = sets.select("id", "shingles").mapInArrow(run, "id long, x long")
    alone = flat.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def link(
    active: DataFrame,
    sets: DataFrame,
    likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """id, component of all members that are linked with another.

    ``active``: key, id, n (set size) of shared buckets; ``sets``: id and full
    shingle set (sorted 64-bit values) of all of them. ``likely`` may drop pairs
    (u, v) before their sets are compared.

    The hub of a bucket is its most central member, the one with fewest
    shingles of its own. A pair x, y that is left must pass two exact bounds:
    neither shares its own shingles with anybody, and with a hub c that both
    were compared with, |x & y| <= |c| - |(c - x) + (c - y)| + min(b(x), b(y)),
    where b(x) counts the shingles of x that are neither its own nor in c. Slots taken
    by one side alone hold shingles that the other lacks; they bound the union
    from below and what both have besides c from above. So a bucket whose members
    differ from their hub in different places makes no pairs of them.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        sized = overlaps(likely(pairs), sets).join(sizes.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(
            sizes.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v"
        )
        return materialised(sized.where(100 * F.col("common") >= threshold * (F.col("nu") + F.col("nv") - F.col("common"))).select("u", "v"))

    own = own_shingles(sets)
    sizes = materialised(
        active.select("id", "n").distinct().join(own, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"))
    )
    # A set with too many shingles of its own is linked with nothing.
    open_ = sizes.where(100 * (F.col("n") - F.col("own")) >= threshold * F.col("n"))
    members = active.select("key", "id").join(open_, "id")
    order = F.struct("own", F.xxhash64("id").alias("o"), "id", "n")
    hub = members.groupBy("key").agg(F.min(order).alias("hub"))
    starred = materialised(
        members.join(hub, "key").select("key", "id", "n", "own", F.col("hub.own").alias("hub_own"), F.col("hub.o").alias("hub_o"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    small = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)
    first = starred.where((F.col("id") != F.col("hub")) & small("n", "hub_n"))
    links = verified(first.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct())
    labels = materialised(components(links))

    labelled = starred.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = materialised(labelled.join(mixed, "key", "left_semi"))
    # One hub of each member, the most central of its buckets' hubs, to bound pairs with.
    # Its keys (at most one a band) tell in which of their buckets a pair is taken.
    pivot = (
        left.groupBy("id")
        .agg(F.min(F.struct("hub_own", "hub_o", "hub", "hub_n")).alias("p"), F.collect_set("key").alias("keys"))
        .select("id", "p.hub", "p.hub_n", "keys")
    )
    shared = differences(pivot.where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")), sets)
    slots = [F.coalesce(c, F.lit(0)).alias(c) for c in LACKS + BESIDES]
    measured = materialised(
        pivot.join(shared.select(F.col("u").alias("id"), "common", *LACKS, *BESIDES), "id", "left").select(
            "id", "keys", F.col("hub").alias("pivot"), F.col("hub_n").alias("pn"), F.coalesce("common", F.col("hub_n")).alias("common"), *slots
        )
    )
    rows = left.select("key", "id", "n", "own", "label").join(measured, "id").withColumn(
        # Shingles neither its own nor in the hub.
        "b", F.greatest(F.col("n") - F.col("common") - F.when(F.col("id") == F.col("pivot"), 0).otherwise(F.col("own")), F.lit(0))
    )
    counts = rows.groupBy("key", "label").count()
    main = counts.groupBy("key").agg(F.max(F.struct("count", "label")).alias("top")).select("key", F.col("top.label").alias("main"))
    rest = rows.join(main, "key").where("label <> main")
    x, y = rest.alias("x"), rows.alias("y")
    c = F.col
    most = F.least(c("x.n") - c("x.own"), c("y.n") - c("y.own"))

    def alone(names: list[str], one: str, other: str):
        """Slots that ``one`` takes and ``other`` does not."""
        return reduce(add, (F.bit_count(c(f"{one}.{n}").bitwiseAND(F.bitwise_not(c(f"{other}.{n}")))) for n in names))

    in_hub = F.least(c("x.common") - alone(LACKS, "y", "x"), c("y.common") - alone(LACKS, "x", "y"))
    besides = F.least(
        c("x.b"),
        c("y.b"),
        c("x.n") - c("x.common") - alone(BESIDES, "x", "y"),
        c("y.n") - c("y.common") - alone(BESIDES, "y", "x"),
    )
    bound = F.when(c("x.pivot") == c("y.pivot"), F.least(most, in_hub + besides)).otherwise(most)
    near = x.join(y, c("x.key") == c("y.key")).where(
        (c("x.label") != c("y.label"))
        & ((c("y.label") == c("x.main")) | (c("x.id") < c("y.id")))
        & small("x.n", "y.n")
        & ((100 + threshold) * bound >= threshold * (c("x.n") + c("y.n")))
        & (F.array_min(F.array_intersect("x.keys", "y.keys")) == c("x.key"))
    )
    pairs = near.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()
    return materialised(components(links.unionByName(verified(pairs))))
