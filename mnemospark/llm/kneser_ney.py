"""Interpolated modified Kneser-Ney model of two or three words over all training documents.

Counting: tasks fold the n-grams of their rows into blocks of (n-gram, count) for each
shard: its words once, frequent ones first, and rows that name them by number. Each shard
task adds its blocks up, writes its n-grams as a table of sorted hashes, cut into
buckets, and passes on what each word gathers as history and as continuation. Those sums
are dealt out by word and written as sorted arrays.

Order three counts trigrams first, in the same way. A bigram then
counts once for each distinct word before it, and what each two-word history
gathers is dealt out by history and written as such a table.

Scoring: workers map the files into memory and look up whole batches by binary
search, so a worker holds no model of its own; the pages are shared by all
workers of a machine. The folder must be mounted under one path everywhere.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import map_batches, texts, worker_state
from mnemospark.llm.shingles import mix, word_hashes, words
from mnemospark.session import materialised, new_folder, shuffles_discarded, unlinked

#: Words are named by 48 bits of their hash: one clash in 500,000 among 10 million words.
MASK = np.uint64((1 << 48) - 1)

#: Marks of a text's begin (a history only) and end (a token).
BEGIN, END = np.uint64(1 << 48), np.uint64((1 << 48) + 1)

#: Tokens that a task folds at once before they are shuffled; about 300 MB of a worker.
FOLD = 4_500_000

#: What is held of a word: its count, distinct words before it; as history its
#: count and distinct continuations that occur once, twice, more often.
COLUMNS = ("count", "before", "total", "once", "twice", "more")

#: Rounds in which blocks are dealt to shards; only a part of them is then on disk twice.
ROUNDS = 4

_codec = pa.Codec("zstd", compression_level=1)
#: Values of a packed column, bytes of each, bytes when compressed.
_HEAD = struct.Struct("<IBQ")

#: The commonest row of each table.
SINGLE = {"pairs": (1,), "triples": (1,), "histories": (1, 1, 0, 0)}
TYPES = (np.uint32, np.uint32, np.uint8, np.uint32, np.uint8, np.uint32, np.uint32)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words and its end."""
    found = words(text)
    return np.append(word_hashes(found) & MASK, END)


def _pairs(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, the token before each, and the tokens of each text."""
    each = [tokens(t) for t in batch]
    sizes = np.array([len(x) for x in each], np.int64)
    after = np.concatenate(each)
    before = np.concatenate([[BEGIN], after[:-1]])
    before[np.cumsum(sizes)[:-1]] = BEGIN
    return before, after, sizes


def _firsts(before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token two before each, from the token before each."""
    first = np.concatenate([[BEGIN], before[:-1]])
    first[np.cumsum(sizes)[:-1]] = BEGIN
    return first


def _key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before) + after)


def _triple_key(first: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(_key(first, before) + after)


def _gram_key(*words: np.ndarray) -> np.ndarray:
    return _key(*words) if len(words) == 2 else _triple_key(*words)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin anew."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _local(folder: str) -> str:
    """The mounted path of a folder."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted folder, not {parts.scheme}://")
    return parts.path


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file, each after its length; under a name of its own first, so that a repeated task does no harm."""
    path = f"{folder}/{name}"
    own = f"{path}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        for x in arrays:
            held = x.tobytes()
            out.write(len(held).to_bytes(8, "little") + held + bytes(-len(held) % 8))
    os.replace(own, path)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one block: the bytes of one place next to each other, compressed."""
    out = []
    for c in columns:
        most = int(c.max()) if len(c) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        held = _codec.compress(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), asbytes=True)
        out += [_HEAD.pack(len(c), width, len(held)), held]
    return b"".join(out)


def _unpack(block: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        n, width, size = _HEAD.unpack_from(block, at)
        at += _HEAD.size
        held = np.frombuffer(_codec.decompress(block[at : at + size], n * width, asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(held.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64))
        at += size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each shard, in the order they have."""
    order = np.argsort(shard, kind="stable")
    at = _runs(shard[order])
    for begin, stop in zip(at, np.append(at[1:], len(order))):
        yield int(shard[order[begin]]), order[begin:stop]


def _word_blocks(shard: np.ndarray, names: np.ndarray, ids: list[np.ndarray], *counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block for each shard: its words, and the rows as numbers of words; rows ascend by the first of ``ids``."""
    for k, own in _by_shard(shard):
        rows = [c[own] for c in ids]
        if 16 * len(own) > len(names):
            there = np.zeros(len(names), bool)
            for c in rows:
                there[c] = True
            used, to = np.flatnonzero(there), np.cumsum(there) - 1
            rows = [to[c] for c in rows]
        else:
            used, to = np.unique(np.concatenate(rows), return_inverse=True)
            rows = np.split(to, len(rows))
        yield k, _pack(names[used], _steps(rows[0]), *rows[1:], *(c[own] for c in counts))


def _word_rows(batches: Iterator[pa.RecordBatch], n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of a shard, frequent ones first, its rows as ``n`` numbers of words, and their counts."""
    blocks = [_unpack(x) for b in batches for x in b["block"].to_pylist()]
    if not blocks:
        return np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * n, []
    names, to = np.unique(np.concatenate([x[0] for x in blocks]), return_inverse=True)
    bounds = np.cumsum([0, *(len(x[0]) for x in blocks)])
    ids = []
    for k in range(1, n + 1):
        own = (np.cumsum(x[1]) if k == 1 else x[k] for x in blocks)
        ids.append(np.concatenate([to[begin + c.astype(np.int64)] for begin, c in zip(bounds, own)]))
    rank = np.empty(len(names), np.int64)
    order = np.argsort(-np.bincount(ids[-1], minlength=len(names)), kind="stable")
    rank[order] = np.arange(len(names))
    counts = [np.concatenate([x[k] for x in blocks]).astype(np.int64) for k in range(n + 1, len(blocks[0]))]
    return names[order], [rank[c] for c in ids], counts


def _grouped(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers below ``size``, and where they begin anew in it."""
    bits = np.uint64(max(size - 1, 1).bit_length())
    if len(ids) * int(bits) > 64:
        order = np.lexsort(ids[::-1])
        return order, _new(*(c[order] for c in ids))
    key = np.zeros(len(ids[0]), np.uint64)
    for c in ids:
        key = (key << bits) | c.astype(np.uint64)
    order = np.argsort(key)
    return order, _runs(key[order])


def _blocks_of(kind: int, blocks: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    shards, held = zip(*blocks)
    parts = [kind * ROUNDS + k % ROUNDS for k in shards]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(shards, pa.int32()), pa.array(held, pa.binary())], names=["part", "shard", "block"])


def _write_table(folder: str, kind: str, shard: int, keys: np.ndarray, values: np.ndarray, single: tuple[int, ...]) -> None:
    """Sorted keys with a row of numbers each, in one file.

    The first bits of a key name its bucket (16 keys or so), the next 38 are kept: 32 and 6. Two
    bits beside them tell whether the row is ``single``, of bytes, or of 32-bit numbers.
    """
    bits = max(len(keys).bit_length() - 4, 0)
    bucket, rest = _cut(keys, bits)
    starts = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.uint32)
    code = np.where((values == single).all(axis=1), 1, np.where(values.max(axis=1) < 256, 2, 3))
    small, large = np.flatnonzero(code == 2), np.flatnonzero(code == 3)
    _save(folder, f"{kind}-{shard}", [
        starts, (rest >> np.uint64(6)).astype(np.uint32), ((rest & np.uint64(63)) << np.uint64(2) | code.astype(np.uint64)).astype(np.uint8),
        small.astype(np.uint32), values[small].astype(np.uint8), large.astype(np.uint32), values[large].astype(np.uint32),
    ])


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, and the 38 bits after it."""
    return (keys >> np.uint64(32) >> np.uint64(32 - bits)).astype(np.int64), keys << np.uint64(bits) >> np.uint64(26)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin anew."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all."""

    folder: str
    shards: int
    n_tokens: int = 0
    n_words: int = 0
    n_bigrams: int = 0
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_classes: np.ndarray = field(default_factory=lambda: np.zeros(4))
    order: int = 2
    triple_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many items occur 1 to 4 times.

    Where a class is empty its formula has no value; half a count is taken. No
    discount is below a tenth, so that every token has some probability.
    """
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if n[1] and n[2]:
        share = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            if n[k] and n[k + 1]:
                out[k] = min(max(k - (k + 1) * share * n[k + 1] / n[k], 0.1), k)
    return out


def _folded(modulus: np.uint64, order: int):
    """Folds the n-grams of a task's texts into blocks of (n-gram, count) by shard."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def folded() -> pa.RecordBatch:
            after, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            names, at, often = np.unique(after, return_inverse=True, return_counts=True)
            by_count = np.argsort(-often, kind="stable")
            rank = np.empty(len(names), np.int64)
            rank[by_count] = np.arange(len(names))
            ids, names = [rank[at]], np.append(names[by_count], BEGIN)
            begins = np.cumsum(sizes) - sizes
            for _ in range(order - 1):
                ids.insert(0, np.concatenate([[0], ids[0][:-1]]))
                ids[0][begins] = len(names) - 1
            sorted_, at = _grouped(ids, len(names))
            counts = np.diff(at, append=len(sorted_))
            ids = [c[sorted_[at]] for c in ids]
            shard = _gram_key(*(names[c] for c in ids)) % modulus
            return _blocks_of(0, _word_blocks(shard.astype(np.int32), names, ids, *[counts] * (4 - order)))

        for batch in batches:
            if batch.num_rows:
                _, after, sizes = _pairs(batch["text"].to_pylist())
                held.append((after, sizes))
                size += len(after)
                if size >= FOLD:
                    yield folded()
                    held, size = [], 0
        if held:
            yield folded()

    return fold


BLOCKS = "part int, shard int, block binary"


def _store(blocks: DataFrame, place: str) -> None:
    """Adds blocks to a folder, one folder inside for each kind and round."""
    blocks.write.mode("append").option("compression", "uncompressed").partitionBy("part").parquet(place)


def _stored(spark: SparkSession, place: str, kind: int | None = None) -> DataFrame:
    """part, shard, block of a kind, or of all kinds."""
    every = spark.read.schema("shard int, block binary, part int").parquet(place)
    return every if kind is None else every.where(F.col("part").between(kind * ROUNDS, (kind + 1) * ROUNDS - 1))


def _dealt(spark: SparkSession, place: str, kind: int, shards: int, fn) -> str:
    """A folder of what ``fn`` gives for the blocks of each shard.

    Shards take rounds; the blocks of a round are dropped when it is done.
    """
    out = new_folder(spark, "grams")
    _store(spark.createDataFrame([], BLOCKS), out)
    for (part,) in sorted(_stored(spark, place, kind).select("part").distinct().collect()):
        own = spark.read.schema("shard int, block binary").parquet(f"{place}/part={part}")
        _store(own.repartitionById(shards, F.col("shard")).mapInArrow(fn, BLOCKS), out)
        unlinked(own)
    return out


def _count_triples(spark: SparkSession, folded: str, place: str, shards: int) -> tuple[str, np.ndarray]:
    """Writes the arrays of three words and of two-word histories, from the folder of folded trigrams.

    Gives a folder of the bigrams in blocks (before, after, n, raw), n being the distinct words
    before them, and how many trigrams occur 1 to 4 times.
    """
    modulus = np.uint64(shards)

    def write_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, counts = _word_rows(batches, 3)
        if not len(names):
            return
        order, at = _grouped(ids, len(names))
        counts = np.add.reduceat(counts[0][order], at)
        first, before, after = ids = [c[order[at]] for c in ids]
        keys = _gram_key(*(names[c] for c in ids))
        by_key = np.argsort(keys)
        shard = int(keys[0] % modulus)
        _write_table(place, "triples", shard, keys[by_key], counts[by_key, None], SINGLE["triples"])

        at = _new(first, before)
        sums = [np.add.reduceat(c.astype(np.int64), at) for c in (counts, counts == 1, counts == 2, counts > 2)]
        history = _key(names[first[at]], names[before[at]])
        by_key = np.argsort(history)
        history, sums = history[by_key], [c[by_key] for c in sums]
        yield _blocks_of(1, ((k, _pack(_steps(history[own]), *(c[own] for c in sums))) for k, own in _by_shard((history % modulus).astype(np.int32))))
        order, at = _grouped([before, after], len(names))
        wide, raw = np.diff(at, append=len(order)), np.add.reduceat(counts[order], at)
        pair = [c[order[at]] for c in (before, after)]
        to = (_key(*(names[c] for c in pair)) % modulus).astype(np.int32)
        yield _blocks_of(0, _word_blocks(to, names, pair, wide, raw))
        yield _blocks_of(2, [(shard, _pack(np.bincount(counts[counts < 5], minlength=5)))])

    def write_histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_unpack(x) for b in batches for x in b["block"].to_pylist()]
        if blocks:
            keys = np.concatenate([np.cumsum(x[0]) for x in blocks])
            order = np.argsort(keys)
            at = _runs(keys[order])
            keys = keys[order[at]]
            sums = np.stack([np.add.reduceat(np.concatenate([x[k] for x in blocks])[order], at) for k in range(1, 5)], axis=1)
            _write_table(place, "histories", int(keys[0] % modulus), keys, sums, SINGLE["histories"])
        # Nothing is left to hand on.
        yield from ()

    made = _dealt(spark, folded, 0, shards, write_triples)
    # A dozen numbers from each shard.
    kinds = [_unpack(r["block"])[0] for r in _stored(spark, made, 2).select("block").collect()]
    _dealt(spark, made, 1, shards, write_histories)
    return made, np.sum([np.zeros(5), *kinds], axis=0)


def train(docs: DataFrame, folder: str, shards: int | None = None, order: int = 2) -> Model:
    """Count all documents and write the arrays; null texts count as empty.

    ``order`` is the number of words of an n-gram, 2 or 3.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = _local(folder)
    os.makedirs(place, exist_ok=True)
    modulus = np.uint64(shards)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, counts = _word_rows(batches, 2)
        if not len(names):
            return
        order_, at = _grouped(ids, len(names))
        counts, raw = (np.add.reduceat(c[order_], at) for c in counts)
        history, follow = (c[order_[at]] for c in ids)
        keys = _key(names[history], names[follow])
        shard = int(keys[0] % modulus)
        by_key = np.argsort(keys)
        _write_table(place, "pairs", shard, keys[by_key], counts[by_key, None], SINGLE["pairs"])

        n = len(names)
        columns = [np.bincount(follow, raw, n).astype(np.int64), np.bincount(follow, minlength=n), np.bincount(history, counts, n).astype(np.int64)]
        columns += [np.bincount(history[own], minlength=n) for own in (counts == 1, counts == 2, counts > 2)]
        by_word = np.argsort(names)
        word, columns = names[by_word], [c[by_word] for c in columns]
        to = (mix(word) % modulus).astype(np.int32)
        yield _blocks_of(0, ((k, _pack(_steps(word[own]), *(c[own] for c in columns))) for k, own in _by_shard(to)))
        # How many bigrams occur 1, 2, 3 and 4 times, and all.
        kinds = np.bincount(counts[counts < 5], minlength=5)[1:]
        yield _blocks_of(1, [(shard, _pack(np.append(kinds, len(keys))))])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, blocks = np.zeros(5, np.int64), []
        for batch in batches:
            for part, block in zip(batch["part"].to_pylist(), batch["block"].to_pylist()):
                if part >= ROUNDS:
                    kinds += _unpack(block)[0].astype(np.int64)
                else:
                    blocks.append(_unpack(block))
        columns = [np.zeros(0, np.int64)] * len(COLUMNS)
        if blocks:
            word = np.concatenate([np.cumsum(x[0]) for x in blocks])
            order_ = np.argsort(word, kind="stable")
            at = _runs(word[order_])
            word = word[order_[at]]
            columns = [np.add.reduceat(np.concatenate([x[k] for x in blocks])[order_], at).astype(np.int64) for k in range(1, len(COLUMNS) + 1)]
            rows = np.stack(columns, axis=1)
            wide = rows.max() >= 1 << 32
            _save(place, f"words-{int(mix(word[:1])[0] % modulus)}", [word, rows.astype(np.uint64 if wide else np.uint32)])
        count, before = columns[0], columns[1]
        seen = count > 0
        classes = [int((before[seen] == k).sum()) for k in (1, 2, 3, 4)] + [int((before[seen] > 2).sum())]
        row = [*kinds.tolist(), int(count.sum()), int(seen.sum()), *classes]
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.int64()))], names=["sums"])

    with shuffles_discarded(spark):
        grams, m = new_folder(spark, "grams"), np.zeros(5)
        _store(texts(docs).select("text").mapInArrow(_folded(modulus, order), BLOCKS), grams)
        if order == 3:
            grams, m = _count_triples(spark, grams, place, shards)
        per_word = _stored(spark, _dealt(spark, grams, 0, shards, write_pairs))
        sums = materialised(per_word.repartitionById(shards, F.col("shard")).mapInArrow(write_words, "sums array<long>"))
        unlinked(per_word)
    # A dozen numbers from each shard.
    total = np.array([r["sums"] for r in sums.collect()], np.int64).reshape(-1, 12).sum(axis=0)
    n, t = np.concatenate([[0], total[:4]]), np.concatenate([[0], total[7:11]])
    return Model(
        place, shards, int(total[5]), int(total[6]), int(total[4]), discounts(n), discounts(t), np.array([0, t[1], t[2], total[11]], float),
        order, discounts(m),
    )


class Arrays:
    """The mapped files of a model in one worker."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def _map(self, name: str) -> list[np.ndarray]:
        """The arrays of a file, as bytes; none without the file."""
        if name not in self.maps:
            path, found, at = f"{self.model.folder}/{name}", [], 0
            held = np.asarray(np.memmap(path, np.uint8, "r")) if os.path.exists(path) else np.zeros(0, np.uint8)
            while at < len(held):
                size = int(held[at : at + 8].view(np.uint64)[0])
                found.append(held[at + 8 : at + 8 + size])
                at += 8 + size + -size % 8
            self.maps[name] = found
        return self.maps[name]

    def _by_shard(self, spread: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = (spread % np.uint64(self.model.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for k in range(self.model.shards):
            if bounds[k] < bounds[k + 1]:
                yield k, order[bounds[k] : bounds[k + 1]]

    @staticmethod
    def _find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that the sorted array has, and which those are."""
        if not len(array):
            return np.zeros(0, np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(array, keys), len(array) - 1)
        known = array[at] == keys
        return at[known], known

    def _rows(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """The row of each key in a table of :func:`_write_table`; zeros for those never seen."""
        single = SINGLE[kind]
        out = np.zeros((len(keys), len(single)), np.int64)
        for k, own in self._by_shard(keys):
            held = self._map(f"{kind}-{k}")
            if not held:
                continue
            starts, low, ends, *rows = (x.view(t) for x, t in zip(held, TYPES))
            bucket, wanted = _cut(keys[own], (len(starts) - 1).bit_length() - 1)
            lo, stop = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
            hi = stop
            # All keys at once are bisected in their buckets.
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                less = open_ & (self._bits(low, ends, np.minimum(mid, len(low) - 1)) < wanted)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            at = np.minimum(lo, len(low) - 1)
            known = (lo < stop) & (self._bits(low, ends, at) == wanted)
            code = np.where(known, ends[at] & 3, 0)
            out[own[code == 1]] = single
            for n, places, values in ((2, rows[0], rows[1]), (3, rows[2], rows[3])):
                of = code == n
                out[own[of]] = values.reshape(-1, len(single))[np.searchsorted(places, at[of].astype(np.uint32))]
        return out

    @staticmethod
    def _bits(low: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        return low[at].astype(np.uint64) << np.uint64(6) | (ends[at] >> 2).astype(np.uint64)

    def counts(self, keys: np.ndarray, kind: str = "pairs") -> np.ndarray:
        """Counts of n-gram keys; 0 for those never seen."""
        return self._rows(kind, keys)[:, 0]

    def words(self, names: np.ndarray) -> np.ndarray:
        """A row of COLUMNS for each word; zeros for strangers."""
        out = np.zeros((len(names), len(COLUMNS)), np.int64)
        for k, own in self._by_shard(mix(names)):
            if held := self._map(f"words-{k}"):
                word = held[0].view(np.uint64)
                at, known = self._find(word, names[own])
                out[own[known]] = held[1].view(np.uint32 if len(held[1]) == 24 * len(word) else np.uint64).reshape(-1, len(COLUMNS))[at]
        return out

    def histories(self, keys: np.ndarray) -> np.ndarray:
        """Total, once, twice and more of two-word histories; zeros for those never seen."""
        return self._rows("histories", keys)

    def log10(self, before: np.ndarray, after: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after the one or two before it, and its training count."""
        m = self.model
        names, at = np.unique(np.concatenate([before, after]), return_inverse=True)
        known = self.words(names)
        history, own = known[at[: len(before)]], known[at[len(before) :]]
        keys, back = np.unique(_key(before, after), return_inverse=True)
        count = self.counts(keys)[back]
        bigrams = max(m.n_bigrams, 1)
        back_off = (m.word_discounts * m.word_classes).sum() / bigrams if m.n_bigrams else 1.0
        wide = own[:, 1]
        lower = np.maximum(wide - m.word_discounts[np.minimum(wide, 3)], 0) / bigrams + back_off / (m.n_words + 1)
        total = np.maximum(history[:, 2], 1)
        kept = np.maximum(count - m.pair_discounts[np.minimum(count, 3)], 0) / total
        share = np.where(history[:, 2] > 0, history[:, 3:] @ m.pair_discounts[1:] / total, 1.0)
        chance = kept + share * lower
        if first is not None:
            names, at = np.unique(_key(first, before), return_inverse=True)
            history = self.histories(names)[at]
            keys, back = np.unique(_triple_key(first, before, after), return_inverse=True)
            count = self.counts(keys, "triples")[back]
            total = np.maximum(history[:, 0], 1)
            kept = np.maximum(count - m.triple_discounts[np.minimum(count, 3)], 0) / total
            share = np.where(history[:, 0] > 0, history[:, 1:] @ m.triple_discounts[1:] / total, 1.0)
            chance = kept + share * chance
        return np.log10(chance), own[:, 0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    A map over the rows. A null or wordless text is its end alone. base_score is
    the add-one unigram log10 probability; perplexity is 10 ** (-score / n_tokens).
    An empty training set leaves one unknown word of probability 1.
    """
    name = uuid.uuid4().hex
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batch: pa.RecordBatch) -> dict:
        before, after, sizes = _pairs(batch["text"].to_pylist())
        first = _firsts(before, sizes) if model.order == 3 else None
        logs, counts = worker_state(name, lambda: Arrays(model)).log10(before, after, first)
        at = np.cumsum(sizes) - sizes
        total = np.add.reduceat(logs, at)
        base = np.log10((counts + 1) / (model.n_tokens + (model.n_words + 1)))
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": sizes,
            "n_known": np.add.reduceat((counts > 0).astype(np.int64), at),
            "train_tokens": np.full(len(sizes), model.n_tokens),
            "base_score": np.add.reduceat(base, at),
            "score": total,
            "perplexity": 10 ** (-total / sizes),
        }

    return map_batches(texts(docs), run, schema)
