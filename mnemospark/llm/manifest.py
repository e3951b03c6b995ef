"""Merkle manifest of a table of documents: a tree per source, and one over the sources.

Every node is labelled by the interval of leaf ranks it covers, [lo, hi). A node of
level k lies in the bucket lo div 3^k; its parent is the node of that bucket one level
up whose interval contains its own, and its siblings are what the parent's interval
holds to the left and to the right of its own. A node whose interval is the whole
tree is the root. Only DataFrame functions are used.

Each level is one grouping of the level below, so rows fall by the fan-in from level to
level; the way up from a leaf is put together from the top down, and documents only
meet the paths of their parents, a third of their own number.

Defined results: a null field counts as ``-``; a null source is a source of its own, the
first; rows without doc_id come first in their source; rows of one doc_id are
ordered by their digests, so repeated rows are leaves of their own; an empty table has
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.ranking import running
from mnemospark.session import broadcast_if_small, materialised

#: Nodes that become one node of the next level.
FAN_IN = 3

#: Columns whose values make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Sources (with the way from each to the root, some kB) that may be broadcast.
BROADCAST_SOURCES = 20_000

#: Siblings to the left and to the right, digests one after the other, by level upwards.
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its value."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*map(part, FIELDS))


class Manifest(NamedTuple):
    """``leaves``: a row per document with its label and ``path`` within its source.

    ``sources``: tree, source, n (leaves), subroot, root and ``above``, the path from the
    subroot to the root.
    """

    leaves: DataFrame
    sources: DataFrame


def build(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of ``docs``; ``carried`` adds columns to the leaves."""
    leaves = materialised(
        docs.select("doc_id", "source", leaf_digest().alias("leaf"), *[c.alias(n) for n, c in carried.items()])
    )
    counted = materialised(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)))
    sources = materialised(running(counted, ["all"], [F.col("source")], {"tree": F.lit(1)}).drop("all"))
    named = broadcast_if_small(sources.withColumnRenamed("source", "named"))
    placed = leaves.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named", "source")
    ranked = running(materialised(placed), ["tree"], [F.col("doc_id"), F.col("leaf")], {"lo": F.lit(1)})
    levels = _grow(materialised(ranked.withColumns({"hi": F.col("lo") + 1, "digest": F.col("leaf")})))

    tops = [level.where("hi - lo = n").select(F.col("tree").alias("lo"), "digest") for level in levels]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    n_trees = sources.count()
    crown = _grow(
        materialised(
            subroots.select(
                F.lit(0).alias("tree"), F.lit(n_trees).cast("long").alias("n"), "lo", (F.col("lo") + 1).alias("hi"), "digest"
            )
        )
    )
    root = crown[-1].where("hi - lo = n").select(F.col("digest").alias("root")).first()
    above = _paths(crown).select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("above"))
    known = sources.join(above, "tree").withColumn("root", F.lit(root["root"] if root else None).cast("string"))
    return Manifest(_paths(levels).drop("digest"), materialised(known))


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """Levels of all trees: ``nodes`` (tree, n, lo, hi, digest), and above it what has ``kids``, too."""
    levels, width = [nodes], 1
    most = nodes.agg(F.max("n")).first()[0] or 0
    while width < most:
        width *= FAN_IN
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        above = (
            levels[-1]
            .where("hi - lo < n")
            .groupBy("tree", "n", _bucket(width))
            .agg(kids.alias("kids"))
            .select(
                "tree",
                "n",
                F.col("kids")[0]["lo"].alias("lo"),
                F.element_at("kids", -1)["hi"].alias("hi"),
                F.sha2(F.concat_ws("", F.col("kids")["digest"]), 256).alias("digest"),
                "kids",
            )
        )
        levels.append(materialised(above))
    return levels


def _bucket(width: int) -> Column:
    return F.expr(f"lo div {width}L").alias("bucket")


def _paths(levels: list[DataFrame]) -> DataFrame:
    """The nodes of the lowest level with ``path``, the siblings on the way to the root of their tree."""
    rooted = [level.where("hi - lo = n").withColumn("path", F.array().cast(PATH)) for level in levels]
    found = rooted[-1]
    for k in range(len(levels) - 1, 0, -1):
        width = FAN_IN**k
        parents = found.select(
            "tree", _bucket(width), F.col("lo").alias("from"), F.col("hi").alias("to"), "kids", F.col("path").alias("up")
        )
        children = levels[k - 1].where("hi - lo < n").withColumnRenamed("kids", "own") if k > 1 else levels[0].where("hi - lo < n")
        joined = children.withColumn("bucket", _bucket(width)).join(parents, ["tree", "bucket"])
        inside = joined.where((F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to")))
        left = F.filter("kids", lambda kid: kid["hi"] <= F.col("lo"))
        right = F.filter("kids", lambda kid: kid["lo"] >= F.col("hi"))
        step = F.struct(
            F.concat_ws("", F.transform(left, lambda kid: kid["digest"])).alias("left"),
            F.concat_ws("", F.transform(right, lambda kid: kid["digest"])).alias("right"),
        )
        inside = inside.withColumn("path", F.concat(F.array(step), "up")).drop("bucket", "from", "to", "kids", "up")
        if k > 1:
            inside = inside.withColumnRenamed("own", "kids")
        found = rooted[k - 1].unionByName(inside)
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves with subroot, root and ``proof``: all siblings from the leaf to the root."""
    known = broadcast_if_small(manifest.sources.select("tree", "source", "subroot", "root", "above"), BROADCAST_SOURCES)
    return (
        manifest.leaves.join(known, "tree")
        .withColumn("proof", F.concat("path", "above"))
        .drop("tree", "n", "lo", "hi", "path", "above")
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its way up amount to."""
    return F.aggregate(proof, leaf, lambda below, step: digest(step["left"], below, step["right"]))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.concat(step["left"], step["right"]))), 256)
