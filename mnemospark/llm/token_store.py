"""Token ids of all documents as binary shards with keyed access.

A store is a folder in shared storage:

* ``shard-N.ids``: raw little-endian ids of its documents, one after the other
  in ascending doc_id order (16 bits where the vocabulary allows, else 32),
* ``shard-N.idx``: a minimal perfect hash over the shard's doc_ids, and by slot
  a 32-bit fingerprint of the key, the offset and the number of ids; besides, keys and
  numbers of ids in document order, for rows without a key of their own (null, repeated),
* ``manifest.json``: width of an id and, by shard, its first and last key,
  documents, ids, and the ids in all shards before it.

A key is found without search: shard by range, slot by hash, then one read.
Every task writes under a name of its own attempt and renames at its end, so a
repeated or speculative task leaves the same files.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.bpe import as_text, default_path, load
from mnemospark.llm.common import map_batches, texts
from mnemospark.llm.shingles import mix

#: Keys in a bucket of the hash on average.
PER_BUCKET = 4

#: Seeds that are tried at once.
SEEDS = 128

#: A marker in place of a null doc_id inside files.
NO_ID = -(1 << 63)

STATS = "shard int, first long, last long, n_docs long, n_ids long"


def _slots(keys: np.ndarray, seeds: np.ndarray | int, n: int) -> np.ndarray:
    return (mix(keys ^ mix(np.atleast_1d(seeds).astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct 64-bit keys.

    Buckets by size, largest first, each take the first seed that sends their
    keys to free slots; a bucket of one key names its slot instead (as -slot-1).
    """
    n = len(keys)
    buckets = max(1, n // PER_BUCKET)
    home = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    taken, moves = np.zeros(n, bool), np.zeros(buckets, np.int64)
    singles = []
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size == 0:
            break
        if size == 1:
            singles.append(b)
            continue
        own, seed = keys[order[starts[b] : starts[b + 1]]], 0
        while True:
            # Many seeds at once; wrong are those with a taken slot or one slot twice.
            slots = np.sort(_slots(own[None, :], np.arange(seed, seed + SEEDS)[:, None], n), axis=1)
            right = ~(taken[slots].any(axis=1) | (slots[:, 1:] == slots[:, :-1]).any(axis=1))
            if right.any():
                break
            seed += SEEDS
        found = int(right.argmax())
        taken[slots[found]], moves[b] = True, seed + found
    free = np.flatnonzero(~taken)
    moves[singles] = -free[: len(singles)] - 1
    return moves


def perfect_slots(keys: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key; keys that were not hashed get some slot, too."""
    move = moves[(mix(keys) % np.uint64(len(moves))).astype(np.int64)]
    return np.where(move < 0, -move - 1, _slots(keys, np.maximum(move, 0), n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _index(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The .idx file: repeated keys point at their first row, null keys at none."""
    offsets = np.cumsum(counts) - counts
    keyed, first = np.unique(ids, return_index=True)
    first = first[keyed != NO_ID]
    keys = ids[first].view(np.uint64)
    arrays = {"ids": ids, "counts": counts}
    if len(keys):
        moves = perfect_hash(keys)
        slots = perfect_slots(keys, moves, len(keys))
        rows = np.empty(len(keys), np.int64)
        rows[slots] = first
        marks = np.empty(len(keys), np.uint32)
        marks[slots] = fingerprints(keys)
        arrays |= {"moves": moves, "marks": marks, "at": offsets[rows], "n": counts[rows]}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return found, path.rstrip("/")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shards: int | None = None) -> list[dict]:
    """Encode all whole texts, write the store and return its manifest's shards.

    One range shuffle of the texts by doc_id. A null text has the end id alone,
    null doc_ids come first, rows of one doc_id are ordered by text.
    """
    spark, path = docs.sparkSession, path or default_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "<u2" if max(len(load(path).token_bytes) - 1, end_id) < 1 << 16 else "<u4"
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        bpe, task = load(path), TaskContext.get()
        shard, own = task.partitionId(), f".{task.taskAttemptId()}"
        name = f"{root}/shard-{shard:06d}"
        end = np.array([end_id], kind).tobytes()
        keys, counts = [], []
        with store.open_output_stream(name + ".ids" + own) as out:
            for batch in batches:
                payload = []
                for found in bpe.encode_batch(as_text(batch["text"])):
                    ids = np.frombuffer(found, "<u4")
                    counts.append(len(ids) + 1)
                    payload += [ids.astype(kind).tobytes(), end]
                keys += [NO_ID if k is None else k for k in batch["doc_id"].to_pylist()]
                out.write(b"".join(payload))
        keys, counts = np.array(keys, np.int64), np.array(counts, np.int64)
        with store.open_output_stream(name + ".idx" + own) as out:
            out.write(_index(keys, counts))
        for suffix in (".ids", ".idx"):
            store.move(name + suffix + own, name + suffix)
        if len(keys):
            row = [shard, int(keys[0]), int(keys[-1]), len(keys), int(counts.sum())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int32() if not k else pa.int64()) for k, v in enumerate(row)],
                names=["shard", "first", "last", "n_docs", "n_ids"],
            )

    ordered = texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    # One short row for each shard.
    rows = [r.asDict() for r in ordered.mapInArrow(run, STATS).collect()]
    rows.sort(key=lambda r: (r["first"], r["shard"]))
    for row, start in zip(rows, accumulate((r["n_ids"] for r in rows), initial=0)):
        row["start"] = start
    store, root = _open(folder)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"kind": kind, "shards": rows}).encode())
    return rows


def manifest(folder: str) -> dict:
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/manifest.json") as file:
        return json.loads(file.read())


def _read(store: fs.FileSystem, path: str, at: int = 0, size: int | None = None) -> bytes:
    with store.open_input_file(path) as file:
        return file.read_at(file.size() if size is None else size, at)


def _places(index: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and number of ids of every document of a shard, in order.

    A key's come from its slot, all keys of the shard at once. Null keys and rows after the
    first of a key have no slot; theirs follow from the numbers before them.
    """
    ids, counts = index["ids"], index["counts"].copy()
    begins = np.cumsum(counts) - counts
    if "moves" not in index:
        return begins, counts
    first = np.unique(ids, return_index=True)[1]
    first = first[ids[first] != NO_ID]
    keys = ids[first].view(np.uint64)
    slots = perfect_slots(keys, index["moves"], len(index["marks"]))
    if (index["marks"][slots] != fingerprints(keys)).any():
        raise ValueError("the index does not hold the keys of its shard")
    begins[first], counts[first] = index["at"][slots], index["n"][slots]
    return begins, counts


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit) of the whole store.

    Documents are found by the perfect hash of their shard; a task reads one shard at a
    time, a stretch of documents at once.
    """
    held = manifest(folder)
    kind, width = held["kind"], np.dtype(held["kind"]).itemsize
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not held["shards"]:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for shard, start in zip(batch["shard"].to_pylist(), batch["start"].to_pylist()):
                name = f"{root}/shard-{shard:06d}"
                index = np.load(io.BytesIO(_read(store, name + ".idx")))
                ids, (begins, counts) = index["ids"], _places(index)
                ends = begins + counts
                stretch = (ends - 1) // (1 << 21)
                with store.open_input_file(name + ".ids") as file:
                    for lot in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(stretch)) + 1):
                        first = int(begins[lot[0]])
                        raw = np.frombuffer(file.read_at((int(ends[lot[-1]]) - first) * width, first * width), kind).astype("<u4")
                        cuts = ends[lot] - first
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[lot], pa.int64(), mask=ids[lot] == NO_ID),
                                pa.array(start + begins[lot], pa.int64()),
                                pa.array(counts[lot], pa.int64()),
                                pa.array([part.tobytes() for part in np.split(raw, cuts[:-1])], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    shards = spark.createDataFrame([(r["shard"], r["start"]) for r in held["shards"]], "shard int, start long")
    return shards.repartition(len(held["shards"])).mapInArrow(run, schema)


class Lookup:
    """Keyed access to a store: one hash, one fingerprint, one read for a key."""

    def __init__(self, folder: str):
        self.store, self.root = _open(folder)
        held = manifest(folder)
        self.kind, self.shards = held["kind"], held["shards"]
        self.firsts = np.array([s["first"] for s in self.shards], np.int64)
        self.open: dict[int, dict] = {}

    def get(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document, or None; a stranger passes a fingerprint once in 2^32."""
        at = int(np.searchsorted(self.firsts, doc_id, side="right")) - 1
        if at < 0 or doc_id > self.shards[at]["last"]:
            return None
        name = f"{self.root}/shard-{self.shards[at]['shard']:06d}"
        if at not in self.open:
            self.open = {at: dict(np.load(io.BytesIO(_read(self.store, name + ".idx"))))}
        index, key = self.open[at], np.array([doc_id], np.int64).view(np.uint64)
        if "moves" not in index:
            return None
        slot = int(perfect_slots(key, index["moves"], len(index["marks"]))[0])
        if index["marks"][slot] != fingerprints(key)[0]:
            return None
        width = np.dtype(self.kind).itemsize
        raw = _read(self.store, name + ".ids", int(index["at"][slot]) * width, int(index["n"][slot]) * width)
        return np.frombuffer(raw, self.kind).astype(np.uint32)


def with_lookup(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids of each key of a table; null for keys the store does not have."""

    def run(batch: pa.RecordBatch) -> dict:
        lookup = Lookup(folder)
        found = [None if k is None else lookup.get(k) for k in batch["doc_id"].to_pylist()]
        return {"doc_id": batch["doc_id"], "ids": [None if f is None else f.astype("<u4").tobytes() for f in found]}

    return map_batches(keys.select("doc_id").sortWithinPartitions("doc_id"), run, "doc_id long, ids binary")
