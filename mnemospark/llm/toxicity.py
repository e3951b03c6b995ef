"""Toxic spans by a linear-chain conditional random field, and document scores.

Labels are given for documents. Words that mark toxic documents give the tokens
of those documents their labels, and a two-state chain is trained on windows of
them: a token's word, beginnings and endings against the state, and the states of
neighbours. Forward-backward over a whole text gives every token's marginal;
their sum and largest value, calibrated on the labelled documents, give the
score of the text, and the runs of likely tokens its offending offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import map_batches, texts, worker_state
from mnemospark.llm.language import _word, words_of

#: Bounds of the labelled documents that the model is fitted on.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4_000, 8_000

#: Marker words: least toxic documents, least log odds against clean ones, most words.
MARKER_DOCS, MARKER_ODDS, MARKERS = 4, 3.0, 4_000

#: Words of a training window; windows of a document around marked words, and elsewhere.
SPAN, MARKED_WINDOWS, OTHER_WINDOWS = 11, 5, 2

SLOTS, STEPS, LOT, RATE, RIDGE = 1 << 16, 120, 8_192, 0.15, 1e-4

THRESHOLD = 0.3
KEPT_WORDS = 200_000


def features(word: str) -> list[int]:
    """Table slots of a word: itself, its beginnings and its endings."""
    parts = ["=" + word, *("^" + word[:n] for n in (3, 4, 5)), *(word[-n:] + "$" for n in (3, 4))]
    return [xxhash.xxh32_intdigest(p) % SLOTS for p in parts]


def mobius(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, block: int = 512) -> np.ndarray:
    """x[t] = (a x[t-1] + b) / (c x[t-1] + d) along a sequence, in blocks side by side.

    The maps of a block are multiplied into one, blocks are joined by those, and
    a second pass fills in the values. A map with a = b and c = d forgets x.
    """
    n = len(a)
    wide = -(-n // block)
    m = [np.concatenate([x, np.full(wide * block - n, float(k in (0, 3)))]).reshape(wide, block).T.copy() for k, x in enumerate((a, b, c, d))]
    p, q, r, s = np.ones(wide), np.zeros(wide), np.zeros(wide), np.ones(wide)
    for j in range(block):
        aj, bj, cj, dj = (x[j] for x in m)
        p, q, r, s = aj * p + bj * r, aj * q + bj * s, cj * p + dj * r, cj * q + dj * s
        scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, starts = 1.0, np.empty(wide)
    for k in range(wide):
        starts[k] = x
        x = (p[k] * x + q[k]) / (r[k] * x + s[k])
    out, x = np.empty((block, wide)), starts
    for j in range(block):
        aj, bj, cj, dj = (y[j] for y in m)
        x = (aj * x + bj) / (cj * x + dj)
        out[j] = x
    return out.T.ravel()[:n]


@dataclass
class Model:
    """Weights of the toxic state, transitions (from, to), begin, and the calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    begin: float = 0.0
    scale: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def emissions(self, words: list[str]) -> np.ndarray:
        return np.array([self.weights[features(w)].sum() for w in words])

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each token, for many texts in a row."""
        if not len(emissions):
            return np.zeros(0)
        e, (t, u) = np.exp(np.clip(emissions, -30, 30)), np.exp(self.moves)
        firsts, lasts = np.zeros(len(e), bool), np.zeros(len(e), bool)
        full = sizes[sizes > 0]
        firsts[np.cumsum(full) - full] = True
        lasts[np.cumsum(full) - 1] = True
        begin = np.exp(self.begin)
        ahead = mobius(
            np.where(firsts, e * begin, e * u[1]), np.where(firsts, e * begin, e * t[1]),
            np.where(firsts, 1.0, u[0]), np.where(firsts, 1.0, t[0]),
        )
        nxt = np.append(e[1:], 1.0)
        back = mobius(
            *(x[::-1] for x in (
                np.where(lasts, 1.0, u[1] * nxt), np.where(lasts, 1.0, u[0]),
                np.where(lasts, 1.0, t[1] * nxt), np.where(lasts, 1.0, t[0]),
            ))
        )[::-1]
        odds = ahead * back
        return odds / (1 + odds)

    def document_scores(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(_signals(total, most) @ self.scale)))


def _signals(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log(total + 1e-3), np.log(most + 1e-3)], axis=1)


def train_chain(slots: np.ndarray, labels: np.ndarray, model: Model) -> None:
    """Ascend the likelihood of labelled windows (n x SPAN x features, n x SPAN) by Adam."""
    draw = np.random.default_rng(7)
    params = [model.weights, model.moves.ravel(), np.array([model.begin])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    span = labels.shape[1]
    for step in range(1, STEPS + 1):
        lot = draw.permutation(len(slots))[:LOT]
        s, y = slots[lot], labels[lot].astype(np.int64)
        weights, moves, begin = params[0], params[1].reshape(2, 2), params[2][0]
        e = np.zeros((len(lot), span, 2))
        e[:, :, 1] = weights[s].sum(axis=2)
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + [0.0, begin]
        for t in range(1, span):
            ahead[:, t] = e[:, t] + np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1])
        for t in range(span - 2, -1, -1):
            nxt = (e + back)[:, t + 1]
            back[:, t] = np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        gap = y - np.exp(ahead[:, :, 1] + back[:, :, 1] - norm)
        grads = [np.bincount(s.ravel(), np.repeat(gap.ravel(), s.shape[2]), SLOTS) / len(lot) - RIDGE * weights]
        pairs = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                expected = np.exp(ahead[:, :-1, i] + moves[i, j] + (e + back)[:, 1:, j] - norm)
                pairs[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j)) - expected).sum() / len(lot)
        grads += [pairs.ravel() - RIDGE * params[1], np.array([gap[:, 0].mean()])]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves, model.begin = params[0], params[1].reshape(2, 2), float(params[2][0])


def calibrate(total: np.ndarray, most: np.ndarray, labels: np.ndarray, weights: np.ndarray, model: Model) -> None:
    """Logistic fit of the document labels (Newton, ridge); weights undo the uneven sample."""
    x, w = _signals(total, most), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - 0.1 * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.linalg.solve(curve, slope)
    model.scale = w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled documents (doc_id, toxic).

    Of each class at most TOXIC_SAMPLE or CLEAN_SAMPLE documents are taken, the
    least by a hash of doc_id; a document with both labels counts as toxic, null
    labels and ids are left out. Without toxic documents every score is a half.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    model = Model()
    if not sizes.get(1):
        return model
    keep = F.lit(False)
    share = {}
    for label, bound in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        share[label] = min(1.0, bound / max(sizes.get(label, 0), 1))
        limit = min(int(-(1 << 63) + share[label] * ((1 << 64) - 1)), (1 << 63) - 1)
        keep = keep | ((F.col("toxic") == label) & (F.xxhash64("doc_id") <= F.lit(limit)))
    # A bounded number of (id, label) rows: safe to broadcast.
    sample = docs.join(F.broadcast(one.where(keep)), "doc_id").where("text is not null")
    sample = texts(sample, F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for word in set(words_of(text.decode("utf-8", "replace"))):
                    seen.setdefault(word, [0, 0])[toxic] += 1
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"word": list(seen), "clean": [c for c, _ in seen.values()], "toxic": [t for _, t in seen.values()]}
            )

    words = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n_toxic, n_clean = sizes[1] * share[1], sizes.get(0, 0) * share[0]
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    top = words.where(F.col("toxic") >= MARKER_DOCS).withColumn("odds", odds).where(F.col("odds") >= MARKER_ODDS)
    markers = frozenset(r["word"] for r in top.orderBy(F.desc("odds"), "word").limit(MARKERS).select("word").collect())

    def windows(batch: pa.RecordBatch) -> dict:
        slots, marks = [], []
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            found = words_of(text.decode("utf-8", "replace"))
            if not found:
                continue
            hits = [k for k, w in enumerate(found) if toxic and w in markers]
            step = xxhash.xxh32_intdigest(text)
            centres = hits[:: max(1, len(hits) // MARKED_WINDOWS)][:MARKED_WINDOWS]
            centres += [(step * (k + 1)) % len(found) for k in range(OTHER_WINDOWS)]
            for centre in centres:
                begin = max(0, min(centre - SPAN // 2, len(found) - SPAN))
                own = found[begin : begin + SPAN]
                own += [""] * (SPAN - len(own))
                slots.append(np.array([features(w) for w in own], np.int32).tobytes())
                marks.append(bytes(int(toxic == 1 and w in markers) for w in own))
        return {"slots": slots, "marks": marks}

    # At most (MARKED_WINDOWS + OTHER_WINDOWS) windows of each sampled document.
    got = map_batches(sample, windows, "slots binary, marks binary").toPandas()
    if not len(got):
        return model
    slots = np.frombuffer(b"".join(got["slots"]), np.int32).reshape(len(got), SPAN, -1)
    train_chain(slots, np.frombuffer(b"".join(got["marks"]), np.uint8).reshape(len(got), SPAN), model)
    signals = _signal_rows(sample, model, "toxic int").toPandas()
    y = signals["toxic"].to_numpy(np.float64)
    calibrate(signals["total"].to_numpy(), signals["most"].to_numpy(), y, np.where(y == 1, 1 / share[1], 1 / share[0]), model)
    return model


class _Worker:
    """The model of a run in one worker, with emissions of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def marginals(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = list(set().union(*found).difference(self.known))
        self.known.update(zip(new, self.model.emissions(new).tolist()))
        sizes = np.array([len(w) for w in found], np.int64)
        known = self.known
        return self.model.marginals(np.fromiter((known[w] for words in found for w in words), np.float64, int(sizes.sum())), sizes), sizes


def _signal_rows(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, total and largest marginal, likely spans (begin, end in characters) of each text."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    extra = [m.split()[0] for m in more]

    def run(batch: pa.RecordBatch) -> dict:
        worker = worker_state(name, lambda: _Worker(shared.value))
        whole = [(t or b"").decode("utf-8", "replace") for t in batch["text"].to_pylist()]
        found = [words_of(t) for t in whole]
        p, sizes = worker.marginals(found)
        total, most, spans = np.zeros(len(whole)), np.zeros(len(whole)), [[] for _ in whole]
        full = np.flatnonzero(sizes)
        if len(full):
            at = (np.cumsum(sizes) - sizes)[full]
            total[full], most[full] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
            for k, a in zip(full, at):
                if most[k] > 0.5:
                    spans[k] = _offsets(whole[k], p[a : a + sizes[k]])
        return {"doc_id": batch["doc_id"], "total": total, "most": most, "spans": spans} | {c: batch[c] for c in extra}

    schema = "doc_id long, total double, most double, spans array<struct<begin:int,end:int,likely:double>>"
    return map_batches(texts(docs, *extra), run, ", ".join([schema, *more]))


def _offsets(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens that are rather toxic than not, as character offsets of the text."""
    places = [m.span() for m in _word.finditer(text)][: len(p)]
    out: list[dict] = []
    before = -2
    for k in np.flatnonzero(p[: len(places)] > 0.5).tolist():
        if k == before + 1:
            out[-1]["end"], out[-1]["likely"] = places[k][1], max(out[-1]["likely"], float(p[k]))
        else:
            out.append({"begin": places[k][0], "end": places[k][1], "likely": float(p[k])})
        before = k
    return out


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, spans of every whole text; one row for each row in.

    Null and empty texts have no tokens and get the score of no evidence.
    """
    rows = _signal_rows(docs, model)
    intercept, a, b = model.scale.tolist()
    logit = intercept + a * F.log(F.col("total") + 1e-3) + b * F.log(F.col("most") + 1e-3)
    score = 1 / (1 + F.exp(-logit))
    return rows.select("doc_id", score.alias("score"), "spans").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
