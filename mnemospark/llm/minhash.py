"""MinHash near-dedup with sequential Bayesian verification.

Documents with the same shingle set are one class; only its least doc_id goes
on. Band keys of its signature bring candidates together. Their signatures are
compared batch by batch: as soon as the posterior probability of the wanted
similarity falls below the chosen miss probability, a pair is dropped; pairs
that outlive all batches are verified on their full sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import map_batches, texts
from mnemospark.llm.linking import THRESHOLD, link, shared_buckets
from mnemospark.llm.shingles import MinHash, band_keys, shingle_set
from mnemospark.session import broadcast_if_small, materialised

#: 40 bands of 5 values find a pair of similarity 0.8 but for 1 in 10 million.
BANDS, ROWS = 40, 5

#: Signature values compared before each look at the posterior.
BATCH = 40

#: A pair is dropped when it is wanted with less than this probability.
MISS = 1e-7

SEED = 20


@lru_cache(maxsize=4)
def _hashes(count: int) -> MinHash:
    return MinHash(count, SEED)


def prune_bounds(total: int, batch: int = BATCH, threshold: int = THRESHOLD, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, least matches to go on) after each batch.

    The prior of the similarity is uniform. Signature values are kept as bytes,
    so that two sets also match in a value by chance, once in 256.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    bounds = []
    for n in range(batch, total + 1, batch):
        least = n
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s * 100 >= threshold].sum() >= miss * weight.sum():
                least = m
                break
        bounds.append((n, least))
    return bounds


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (128 bits of the whole set), signature (bytes), keys (of bands)."""

    def run(batch: pa.RecordBatch) -> dict:
        hashes, seen = _hashes(bands * rows), {}
        sizes, names, signatures = [], [], []
        for text in batch["text"].to_pylist():
            if text not in seen:
                shingles = shingle_set(text, width)
                seen[text] = (len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), hashes(shingles))
            size, name, signature = seen[text]
            sizes.append(size)
            names.append(name)
            signatures.append(signature)
        stacked = np.stack(signatures)
        keys = band_keys(stacked, rows)
        return {
            "doc_id": batch["doc_id"],
            "text_key": batch["text_key"],
            "n_shingles": sizes,
            "set_key": names,
            "signature": [x.tobytes() for x in stacked.astype(np.uint8)],
            "keys": pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64))
            ),
        }

    schema = "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, keys array<long>"
    return map_batches(texts(docs, F.xxhash64("text").alias("text_key")), run, schema)


def _likely(pairs: DataFrame, signatures: DataFrame, threshold: int, total: int) -> DataFrame:
    """Pairs (u, v) that outlive the sequential comparison of their signatures."""
    bounds = prune_bounds(total, threshold=threshold)

    def run(batch: pa.RecordBatch) -> dict:
        u, v = batch["u"].to_numpy(), batch["v"].to_numpy()
        a, b = (
            np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(u), total) for c in ("su", "sv")
        )
        live, matches, start = np.arange(len(u)), np.zeros(len(u), np.int64), 0
        for n, least in bounds:
            matches = matches + (a[live, start:n] == b[live, start:n]).sum(axis=1)
            stay = matches >= least
            live, matches, start = live[stay], matches[stay], n
        return {"u": u[live], "v": v[live]}

    both = pairs.join(signatures.select(F.col("id").alias("u"), F.col("signature").alias("su")), "u").join(
        signatures.select(F.col("id").alias("v"), F.col("signature").alias("sv")), "v"
    )
    return map_batches(both.select("u", "v", "su", "sv"), run, "u long, v long")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and full shingle set of the documents with these ids."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch["doc_id"], "shingles": [shingle_set(t, width).tobytes() for t in batch["text"].to_pylist()]}

    wanted = docs.join(broadcast_if_small(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return map_batches(texts(wanted), run, "id long, shingles binary")


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: groups of documents of similar word shingles.

    One row for each row in; text_key (64-bit hash of the text) tells rows of one doc_id apart. A text of fewer than ``width`` words is one shingle;
    a null or wordless text has none and is linked with nothing. Of a doc_id that
    occurs more than once with the same text, all rows are alike; with different
    texts, the doc_id stands for its text of the largest set key. A null doc_id cannot be
    linked or named: its component is null and it is kept.
    """
    drawn = materialised(sketches(docs, width, bands, rows))
    usable = drawn.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    one_text = classes.groupBy("id").agg(F.max("set_key").alias("set_key"))
    reps = materialised(
        usable.withColumnRenamed("doc_id", "id").join(one_text, ["id", "set_key"])
        .dropDuplicates(["id"]).select("id", "set_key", F.col("n_shingles").alias("n"), "signature", "keys")
    )
    active = materialised(shared_buckets(reps.select(F.explode("keys").alias("key"), "id", "n")))
    ids = active.select("id").distinct()
    sets = materialised(full_sets(docs, ids, width).join(reps.select("id", "n"), "id").where(F.octet_length("shingles") == 8 * F.col("n")).dropDuplicates(["id"]).select("id", "shingles"))
    signatures = materialised(reps.join(ids, "id", "left_semi").select("id", "signature"))

    found = link(active, sets, lambda pairs: _likely(pairs, signatures, threshold, bands * rows), threshold)
    changed = (
        classes.join(found, "id", "left")
        .where("copies > 1 or component is not null")
        .select("set_key", F.coalesce("component", "id").alias("component"))
    )
    joined = drawn.join(broadcast_if_small(changed), "set_key", "left")
    named = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    component = F.coalesce(named, F.col("doc_id"))
    return joined.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
