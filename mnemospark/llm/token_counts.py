"""Token counts of whole texts from a two-tier table of word lengths.

Frequent words and their token counts are broadcast as one compact hash table of
fixed size; any other word is encoded once by a worker and kept there. Words are
never shuffled: the frequent ones are chosen from bounded summaries that each
task makes of its own rows. Which words are frequent changes the speed alone.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bpe import WordBpe, as_text, default_path, load
from mnemospark.llm.common import map_batches, texts, worker_state

#: Words in the broadcast table: about 1 MB, whatever the size of the corpus.
FREQUENT = 32_768

#: Words a task's summary may name, and words it counts before it drops the rarest half.
SUMMARY, COUNTED = 4_096, 200_000

#: Words besides that a worker keeps; bounds memory only.
KEPT_COUNTS = 300_000


def frequent_words(docs: DataFrame, path: str, size: int = FREQUENT) -> list[tuple[str, int]]:
    """The most frequent words of all documents, as far as bounded task summaries tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = load(path), Counter()
        for batch in batches:
            for text in as_text(batch["text"]):
                seen.update(bpe.words(text))
            if len(seen) > COUNTED:
                seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(SUMMARY)
        if top:
            yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": pa.array([n for _, n in top], pa.int64())})

    summaries = texts(docs).select("text").mapInArrow(run, "word string, n long")
    rows = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    words = [r["word"] for r in rows]
    ids = load(path).learn(set(words))
    return [(w, len(ids[w]) // 4) for w in words]


class WordLengths:
    """Open-addressed table of (64-bit word hash -> length) with the words to compare."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.text = "\n".join(w for w, _ in entries)
        self.lengths = np.array([n for _, n in entries], np.uint32).tobytes()

    def as_dict(self) -> dict[str, int]:
        """No word holds a line break: the word pattern leaves out white space."""
        names = self.text.split("\n") if self.lengths else []
        return dict(zip(names, np.frombuffer(self.lengths, np.uint32).tolist()))


class _Tiers:
    """Broadcast words, and the words this worker met besides."""

    def __init__(self, frequent: dict[str, int], path: str):
        self.bpe, self.frequent, self.kept = WordBpe(path), frequent, {}

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.bpe.words(t) for t in texts]
        new = set().union(*split).difference(self.frequent)
        if len(self.kept) > KEPT_COUNTS:
            self.kept = {}
        new = new.difference(self.kept)
        if new:
            specials = new.intersection(self.bpe.fixed)
            words = list(new - specials)
            self.kept |= {w: len(ids) // 4 for w, ids in zip(words, self.bpe.encode_words(words))} | dict.fromkeys(specials, 1)
        table = _Chain(self.frequent)
        table.kept = self.kept
        return [sum(map(table.__getitem__, words)) for words in split]


class _Chain(dict):
    kept: dict[str, int]

    def __missing__(self, word: str) -> int:
        return self.kept[word]


def count_tokens(docs: DataFrame, path: str | None = None, size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text.

    A map over the rows with one broadcast of at most ``size`` words; repeated rows
    come out repeated, a null text counts as empty (0 bytes, 0 tokens).
    """
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(WordLengths(frequent_words(docs, path, size)))

    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        counts = worker_state(name, lambda: _Tiers(shared.value.as_dict(), path)).counts(as_text(batch["text"]))
        return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts}

    return map_batches(texts(docs, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), run, "doc_id long, n_bytes long, n_tokens long")
