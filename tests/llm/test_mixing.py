"""The mix of sources: targets by plain filling, takings by counting the mix itself."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mixing
from mnemospark.llm.common import ready
from tests.llm.cases import TEXTS, documents


def plain_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain_targets(sizes):
    """Source sizes in order: weights share 150 %, capped ones leave their excess to the rest."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total > 2 * sizes[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = 2.0 * sizes[k]
        left, open_ = left - sum(out[k] for k in full), open_ - full
    return out


def corpus(spark, sizes, seed=1):
    """Documents of random lengths; names sort by code point, the last source is null."""
    rng, rows = np.random.default_rng(seed), []
    for at, size in enumerate(sizes):
        name = None if at == len(sizes) - 1 else f"s{at:02d}"
        left = size
        while left > 0:
            n = int(min(left, rng.integers(1, 300)))
            rows.append((len(rows), name, "\n ".join(f"w{len(rows)}_{k}" for k in range(n)) + " "))
            left -= n
    return ready(spark).createDataFrame(rows, "doc_id long, source string, text string").repartition(4), rows


@pytest.mark.parametrize("sizes", [[900, 10_000, 20_000, 3_000], [5_000], [64, 64, 6_400, 1, 130]])
def test_targets_and_takings(spark, sizes):
    docs, rows = corpus(spark, sizes)
    mixed = mixing.mix(docs, shard=16)
    found = {r["doc_id"]: r for r in mixing.words_taken(mixed).collect()}
    assert len(found) == len(rows)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    totals = Counter()
    for _, s, t in rows:
        totals[s] += len(plain_words(t))
    wanted = dict(zip(names, plain_targets([totals[s] for s in names])))
    taken = Counter()
    for doc_id, source, text in rows:
        row = found[doc_id]
        assert row["size"] == len(plain_words(text)) and row["source_size"] == totals[source]
        assert row["target"] == pytest.approx(wanted[source]) and 0 <= row["taken"] <= 2 * row["size"]
        taken[source] += row["taken"]
    for s in names:
        assert abs(taken[s] - wanted[s]) <= mixing.BLOCK, (s, taken[s], wanted[s])


def test_texts_are_what_was_taken(spark):
    docs, rows = corpus(spark, [700, 5_000, 1_000])
    mixed = mixing.mix(docs, shard=16)
    out = mixing.mixed_texts(docs, mixed).collect()
    counts = Counter(w.split("_")[0] for r in out for w in r["text"].split())
    assert counts == {f"w{r['doc_id']}": r["taken"] for r in mixing.words_taken(mixed).collect() if r["taken"]}
    slots = defaultdict(set)
    for r in out:
        slots[r["shard"]].add(r["slot"])
        assert len(r["text"].split()) <= mixing.BLOCK
    # Every shard but the last is full, and draws of its own: not all have the same counts.
    assert all(s == set(range(16)) for k, s in slots.items() if k < max(slots))
    by_shard = defaultdict(Counter)
    for r in out:
        by_shard[r["shard"]][r["src"]] += 1
    assert len({tuple(sorted(c.items())) for c in by_shard.values()}) > 2


def test_reruns_agree(spark):
    docs, _ = corpus(spark, [700, 5_000, 1_000])
    first, second = (sorted(map(tuple, mixing.mix(d).slots.collect())) for d in (docs, docs.repartition(3)))
    assert first == second
    assert first != sorted(map(tuple, mixing.mix(docs, seed=1).slots.collect()))


def test_awkward_rows(spark):
    docs = documents(ready(spark)).withColumn("source", F.when(F.col("doc_id") < 8, F.lit("ü")).when(F.col("doc_id") < 12, F.lit("z")))
    rows = mixing.words_taken(mixing.mix(docs)).collect()
    assert sorted(r["size"] for r in rows) == sorted(len(plain_words(t)) for _, t, _ in TEXTS)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.words_taken(mixing.mix(documents(spark, []))).collect() == []
    nothing = mixing.words_taken(mixing.mix(documents(spark, [(1, None, None), (2, " ", None)]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


def test_many_sources_draw_by_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 2)
    docs, rows = corpus(spark, [900, 2_000, 4_000, 3_000, 800])
    mixed = mixing.mix(docs, shard=16)
    taken, target = Counter(), {}
    for r in mixing.words_taken(mixed).collect():
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)


def test_permutations():
    for size in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5):
            got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(got) == list(range(size))
    wide = np.full(1000, (1 << 40) + 3)
    assert len(set(mixing.permuted(np.arange(1000), wide, np.zeros(1000, np.uint64)).tolist())) == 1000


def test_words_like_a_plain_split(spark):
    texts = ["", " ", "a", " a", "a ", "\x0b a\x0c b\x1fc ", "a b", None]
    rows = ready(spark).createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in rows.coalesce(1).select(mixing.n_words(F.col("text"))).collect()]
    assert got == [len(plain_words(t)) for t in texts]
