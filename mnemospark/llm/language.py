"""Language spans of mixed texts: scripts, word scores, Viterbi.

Each word (a run of letters) has a script, which leaves the languages that are
written in it, and for each of those a score: the log likelihood of its letter
groups in the language. Viterbi over the words of a text, with a penalty for
each change of language, labels the spans.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import forget, map_batches, texts, worker_state

#: Bound of the labelled rows that the model is fitted on, for each language.
SAMPLE = 4_000

#: Slots of the table of letter groups, lengths of the groups, smoothing.
SLOTS, GROUPS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5

#: Log likelihood that a change of language between two words costs.
SWITCH = 8.0

#: A language whose script has less than this share of its letters is no candidate there.
SCRIPT_SHARE = 0.01

UNKNOWN = "und"
KEPT_WORDS = 200_000

_ascii_word = re.compile(r"[a-z]+")
_word = regex.compile(r"\p{L}[\p{L}\p{M}]*")

#: First characters of ranges with their script; fixed values of the Unicode standard.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_starts = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
_codes = np.array([NAMES.index(name) for _, name in SCRIPTS])


def scripts(words: list[str]) -> np.ndarray:
    """Script number of each word, by its first letter."""
    return _codes[np.searchsorted(_starts, [ord(w[0]) for w in words], side="right") - 1]


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (with their marks)."""
    if text.isascii():
        return _ascii_word.findall(text.lower())
    return _word.findall(unicodedata.normalize("NFC", text).lower())


def letter_groups(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all letter groups of all words (with marks at the ends), and words' bounds."""
    marked = ["\x02" + w + "\x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    slots, owners = [], []
    for n in GROUPS:
        if len(points) < n:
            continue
        count = len(points) - n + 1
        inside = owner[:count] == owner[n - 1 :]
        key = np.full(count, n, np.uint64)
        for k in range(n):
            key = (key + points[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        slots.append((key[inside] % np.uint64(SLOTS)).astype(np.int64))
        owners.append(owner[:count][inside])
    return np.concatenate(slots), np.concatenate(owners)


class Model:
    """Languages, script shares and log likelihoods of letter-group slots."""

    def __init__(self, languages: list[str], counts: np.ndarray, script_letters: np.ndarray):
        self.languages = languages
        self.logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * SLOTS)).T.astype(np.float32)
        share = script_letters / np.maximum(script_letters.sum(axis=1, keepdims=True), 1)
        #: By script and language: whether the language is a candidate there.
        self.candidate = (share >= SCRIPT_SHARE).T
        #: A script that no language has leaves all of them.
        self.candidate[~self.candidate.any(axis=1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word by language; far below all others where the script rules it out."""
        slots, owners = letter_groups(words)
        total = np.zeros((len(words), len(self.languages)))
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(owners, self.logs[slots, k], len(words))
        return np.where(self.candidate[scripts(words)], total, total.min(axis=1, keepdims=True) - 1e4)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of the words of many texts, one below the other; ties: the first language.

    Texts advance side by side, longest first, so that a step is one operation
    for all texts that still have words.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n, steps = scores.shape[1], int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    labels = np.zeros(len(scores), np.int8)
    came = np.empty((len(scores), n), np.int8)
    own = np.arange(n, dtype=np.int8)
    best = np.zeros((len(sizes), n))
    for t in range(steps):
        at = starts[: live[t]] + t
        now = best[: live[t]]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(len(now)), top][:, None] - switch
            stay = now >= jump
            came[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, jump)
        best[: live[t]] = now + scores[at]
    last = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        at = starts[: live[t]] + t
        labels[at] = last[: live[t]]
        if t:
            last[: live[t]] = came[at, labels[at]]
    return labels


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind (0: letter groups, 1: scripts), slot and n of a task's labelled texts."""
    forget()
    counts: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            words = words_of(text.decode("utf-8", "replace"))
            if words:
                own = counts.setdefault(lang, [np.zeros(SLOTS, np.int64), np.zeros(len(NAMES), np.int64)])
                own[0] += np.bincount(letter_groups(words)[0], minlength=SLOTS)
                own[1] += np.bincount(scripts(words), [len(w) for w in words], len(NAMES)).astype(np.int64)
    for lang, both in counts.items():
        for kind, found in enumerate(both):
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(at), "kind": pa.array([kind] * len(at), pa.int32()), "slot": pa.array(at, pa.int32()), "n": found[at]}
            )


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Count letter groups and scripts by language over a bounded sample of whole texts.

    About ``sample`` rows a language: those below a cut of a hash of doc_id and text, so the
    same ones in any order of rows, and copies of a text are drawn one by one. The
    result is one row a language of at most SLOTS counts.
    """
    rows = labelled.where("text is not null and lang is not null")
    draw = F.xxhash64("doc_id", "text")
    # The cut by hash comes from counts alone; no text is sorted or shuffled for it.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, SLOTS)), np.zeros((0, len(NAMES))))
    keep = F.lit(False)
    for lang, count in sizes.items():
        limit = int(-(1 << 63) + min(1.0, sample / count) * ((1 << 64) - 1))
        keep = keep | ((F.col("lang") == lang) & (draw <= F.lit(min(limit, (1 << 63) - 1))))
    bounded = rows.where(keep).select(F.col("lang"), F.col("text").cast("binary").alias("text"))

    summed = bounded.mapInArrow(_counted, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))
    # At most languages * (SLOTS + scripts) rows.
    got = summed.toPandas()
    languages = sorted(got["lang"].unique())
    counts, letters = np.zeros((len(languages), SLOTS)), np.zeros((len(languages), len(NAMES)))
    row = got["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy(np.int64)
    for kind, into in ((0, counts), (1, letters)):
        own = (got["kind"] == kind).to_numpy()
        into[row[own], got["slot"].to_numpy()[own]] = got["n"].to_numpy()[own]
    return Model(languages, counts, letters)


class _Worker:
    """The model of a run in one worker, with the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.index, self.table = model, {}, np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.index) > KEPT_WORDS:
            self.index, self.table = {}, self.table[:0]
        new = list(words.difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.table = np.concatenate([self.table, self.model.scores(new)])

    def label(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in found], np.int64)
        self.learn(set().union(*found))
        at = np.fromiter((self.index[w] for words in found for w in words), np.int64, int(lengths.sum()))
        return viterbi(self.table[at], lengths), lengths


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, spans (lang, first word, words, letters) of every whole text.

    Columns named in ``carry`` come along as they are.
    lang_pred is the language with most letters in its spans, score its share of
    all letters. A null text, one without letters, or a model without languages
    gives ``und``, 0 and no spans. One row for each row in.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:long,words:long,letters:long>>"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batch: pa.RecordBatch) -> dict:
        worker = worker_state(name, lambda: _Worker(shared.value))
        names = worker.model.languages
        found = [words_of(t.decode("utf-8", "replace")) if t and names else [] for t in batch["text"].to_pylist()]
        labels, lengths = worker.label(found) if names else (np.zeros(0, np.int8), np.zeros(len(found), np.int64))
        preds, scores, spans = [], [], []
        for words, end, n in zip(found, np.cumsum(lengths), lengths):
            if not n:
                preds.append(UNKNOWN)
                scores.append(0.0)
                spans.append([])
                continue
            own = labels[end - n : end].astype(np.int64)
            letters = np.fromiter(map(len, words), np.int64, n)
            share = np.bincount(own, letters, len(names))
            first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            preds.append(names[int(share.argmax())])
            scores.append(float(share.max() / share.sum()))
            spans.append(
                [
                    {"lang": names[k], "first": f, "words": w, "letters": c}
                    for k, f, w, c in zip(
                        own[first].tolist(), first.tolist(), np.diff(first, append=n).tolist(), np.add.reduceat(letters, first).tolist()
                    )
                ]
            )
        return {"doc_id": batch["doc_id"], "lang_pred": preds, "score": scores, "spans": spans} | {
            c: batch[f"_{c}"] for c in carry
        }

    return map_batches(texts(docs, *[F.col(c).alias(f"_{c}") for c in carry]), run, schema)
