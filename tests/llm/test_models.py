"""Trained operators: exact decoding against plain versions, held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import common, fingerprints, kneser_ney, language, toxicity
from mnemospark.llm.common import crc_is, ready, table
from mnemospark.session import new_folder
from tests.llm.cases import TEXTS, by_rows, documents, remainder

FOLDER = "/root/testdata/sf0.001"


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 6, 3])
    scores = draw.normal(0, 4, (lengths.sum(), 3))
    labels = language.viterbi(scores, lengths, switch=3.0)
    start = 0
    for n in lengths:
        own, got = scores[start : start + n], labels[start : start + n]
        value = lambda path: sum(own[t, s] for t, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert tuple(got) == best
        start += n
    assert len(language.viterbi(np.zeros((0, 3)), np.zeros(0, np.int64))) == 0


def test_training_drops_what_an_earlier_job_left_in_the_worker():
    common.worker_state("earlier job", dict)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": pa.array([b"some words"], pa.binary())})
    assert sum(b.num_rows for b in language._counted(iter([batch]))) > 0
    assert not common._STATE
    made = common.worker_state("next job", lambda: len(common._STATE))
    assert made == 0 and list(common._STATE) == ["next job"]
    common.forget()
    assert not common._STATE


def test_languages(spark):
    docs = table(ready(spark), FOLDER, "documents")
    model = language.fit(docs.where(~crc_is(3, 1)))
    held = language.identify(docs.where(crc_is(3, 1)), model).join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    mixed = [(1, f"{a} {b}", None) for a, b in [(held.where("lang = 'de'").first()["text"][:400], held.where("lang = 'en'").first()["text"][:400])]]
    spans = language.identify(documents(spark, mixed), model).first()["spans"]
    assert [s["lang"] for s in spans][0] == "de" and [s["lang"] for s in spans][-1] == "en"
    assert sum(s["words"] for s in spans) == len(language.words_of(mixed[0][1]))


def test_languages_of_awkward_rows(spark):
    docs = documents(ready(spark))
    model = language.fit(docs)
    got = by_rows(language.identify(docs, model, ("lang",)), "doc_id", "lang_pred", "score")
    assert len(got) == len(TEXTS)
    und = {(i, language.UNKNOWN, 0.0) for i, t, _ in TEXTS if not any(c.isalpha() for c in t or "")}
    assert {r for r in got if r[1] == language.UNKNOWN} == und
    assert all(0 < s <= 1 for _, g, s in got if g != language.UNKNOWN)
    empty = language.fit(docs.where("false"))
    assert {r[1] for r in by_rows(language.identify(docs, empty), "doc_id", "lang_pred")} == {language.UNKNOWN}
    assert language.identify(docs.where("false"), model).count() == 0


def test_scripts_narrow_the_candidates(spark):
    rows = [(1, "привет мир " * 9, "ru"), (2, "hello world " * 9, "en"), (3, "γειά κόσμε " * 9, "el")]
    model = language.fit(documents(ready(spark), rows))
    asked = documents(spark, [(1, "мхрквз", None), (2, "xqzv", None), (3, "ωψξ", None)])
    assert by_rows(language.identify(asked, model), "doc_id", "lang_pred") == [(1, "ru"), (2, "en"), (3, "el")]


def test_marginals_are_those_of_all_paths():
    draw = np.random.default_rng(4)
    model = toxicity.Model(moves=draw.normal(0, 1, (2, 2)), begin=0.3)
    sizes = np.array([3, 0, 1, 7, 600])
    e = draw.normal(0, 2, sizes.sum())
    got, start = model.marginals(e, sizes), 0
    for n in sizes[:4]:
        own, total = e[start : start + n], np.zeros(n)
        norm = 0.0
        for path in itertools.product((0, 1), repeat=int(n)) if n else ():
            weight = math.exp(
                sum(own[t] * s for t, s in enumerate(path)) + 0.3 * path[0] + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
            )
            norm += weight
            total += weight * np.array(path)
        if n:
            assert np.allclose(got[start : start + n], total / norm)
        start += n
    alone = model.marginals(e[start:], np.array([600]))
    assert np.allclose(got[start:], alone)


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(ready(spark), folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~crc_is(4, 2)))
    rows = toxicity.toxicity(docs, model).join(labels.where(crc_is(4, 2)), "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.1 * len(clean)
    ranked = sum(a["score"] > b["score"] for a in toxic for b in clean)
    assert ranked >= 0.8 * len(toxic) * len(clean)
    got = toxicity.toxicity(documents(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(not r["spans"] for r in got if r["doc_id"] in (4, 5, 6))
    assert toxicity.toxicity(documents(spark, []), model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.toxicity(documents(spark), none).collect()} == {0.5}


def plain_model(rows):
    """The same model with dictionaries."""
    texts = [[*(t or "").encode().lower().split(), None] for t in rows]
    count, pairs = collections.Counter(), collections.Counter()
    for own in texts:
        count.update(own)
        pairs.update(zip([0, *own], own))
    before = collections.Counter(b for _, b in pairs)
    kinds = lambda c: np.array([0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))])
    d, e = kneser_ney.discounts(kinds(pairs)), kneser_ney.discounts(kinds(before))
    size, seen = len(pairs), len(count)
    rest = sum(e[min(v, 3)] for v in before.values()) / size if size else 1.0

    def lower(w):
        return max(before[w] - e[min(before[w], 3)], 0) / max(size, 1) + rest / (seen + 1)

    def chance(a, b):
        own = [v for (x, _), v in pairs.items() if x == a]
        if not own:
            return lower(b)
        c = pairs[a, b]
        return max(c - d[min(c, 3)], 0) / sum(own) + sum(d[min(v, 3)] for v in own) / sum(own) * lower(b)

    return count, chance, texts


@pytest.mark.parametrize("divisor", [3, 1])
def test_kneser_ney(spark, divisor):
    """divisor 1: nothing to learn from."""
    train = [t for i, t, _ in TEXTS if remainder(i, divisor)]
    docs = documents(ready(spark))
    model = kneser_ney.train(docs.where(~crc_is(divisor, 0)), new_folder(spark, "kn-test"), shards=3)
    count, chance, _ = plain_model(train)
    n, v = sum(count.values()), len(count)
    assert (model.n_tokens, model.n_words) == (n, v)
    _, _, texts = plain_model([t for _, t, _ in TEXTS])
    want = []
    for (doc_id, _, _), own in zip(TEXTS, texts):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        cache = {p: math.log10(chance(*p)) for p in set(zip([0, *own], own))}
        want.append((doc_id, len(own), sum(w in count for w in own), n, base, sum(cache[p] for p in zip([0, *own], own))))
    got = by_rows(kneser_ney.score(docs, model), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want.sort(key=lambda r: [(x is not None, x) for x in r])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])
    assert kneser_ney.score(documents(spark, []), model).count() == 0


def test_kneser_ney_sums_to_one(spark):
    rows = [(k, " ".join(random.Random(k).choices("abcdefg", k=20)), None) for k in range(40)]
    model = kneser_ney.train(documents(ready(spark), rows), new_folder(spark, "kn-test"), shards=2)
    arrays = kneser_ney.Arrays(model)
    words = np.append(kneser_ney.tokens(b"a b c d e f g zzz"), [])
    for history in (*words[:3], kneser_ney.BEGIN, words[7]):
        logs, _ = arrays.log10(np.full(len(words), history, np.uint64), words.astype(np.uint64))
        assert abs((10**logs).sum() - 1) < 1e-9


def plain_three(rows):
    """The model of three words with dictionaries."""
    texts = [[*(t or "").encode().lower().split(), None] for t in rows]
    triples = collections.Counter(x for own in texts for x in zip([0, 0, *own], [0, *own], own))
    pairs = collections.Counter((v, w) for _, v, w in triples)
    ends = collections.Counter(w for _, w in pairs)
    kinds = lambda c: np.array([0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))])
    levels = [(c, kneser_ney.discounts(kinds(c))) for c in (triples, pairs, ends)]

    def chance(*gram):
        if not gram:
            return 1 / (len(ends) + 1)
        c, d = levels[3 - len(gram)]
        own = [n for g, n in c.items() if len(gram) == 1 or g[:-1] == gram[:-1]]
        if not own:
            return chance(*gram[1:])
        n = c[gram if len(gram) > 1 else gram[0]]
        return max(n - d[min(n, 3)], 0) / sum(own) + sum(d[min(v, 3)] for v in own) / sum(own) * chance(*gram[1:])

    return chance, texts


def test_kneser_ney_of_three_words(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choices("abcdefg", range(1, 8), k=draw.randrange(30))), None) for k in range(60)] + [(60, None, None)]
    docs = documents(ready(spark), rows)
    model = kneser_ney.train(docs.where("doc_id % 4 > 0"), new_folder(spark, "kn-test"), shards=3, order=3)
    chance, _ = plain_three([t for i, t, _ in rows if i % 4])
    _, texts = plain_three([t for _, t, _ in rows])
    want = [sum(math.log10(chance(*x)) for x in zip([0, 0, *own], [0, *own], own)) for own in texts]
    got = kneser_ney.score(docs, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in got], want)
    assert got[0]["train_tokens"] == sum(len(own) for (i, _, _), own in zip(rows, texts) if i % 4)
    arrays = kneser_ney.Arrays(model)
    words = kneser_ney.tokens(b"a b c d e f g zzz")
    for u, v in itertools.product((*words[:3], kneser_ney.BEGIN, words[7]), repeat=2):
        logs, _ = arrays.log10(np.full(9, v, np.uint64), words, np.full(9, u, np.uint64))
        assert abs((10**logs).sum() - 1) < 1e-9


def test_query_scores_with_three_words(spark, monkeypatch):
    from mnemospark.llm import queries

    seen, score = [], kneser_ney.score
    monkeypatch.setattr(kneser_ney, "score", lambda docs, model: seen.append(model.order) or score(docs, model))
    assert queries.QUERIES["op10_lm_score"](spark, FOLDER).count() and seen == [3]


def jaccard(a, b):
    a, b = (collections.Counter((t or "").lower().split()) for t in (a, b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_fingerprints(spark):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(draw.choices(words[: 20 + 10 * (k % 15)], k=20 + k)), None) for k in range(90)]
    rows += [(200, rows[0][1], None), (201, "", None), (202, None, None), (203, "é" * 7, None)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(ready(spark), rows)).collect()}
    assert len(got) == len(rows)
    error = []
    for k, (i, t, _) in enumerate(rows):
        text, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        row = got[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        error += [row["near_edited"] - jaccard(text, edited), row["near_next"] - jaccard(text, follow)]
    assert abs(np.mean(error)) < 0.03 and np.sqrt(np.mean(np.square(error))) < 0.12
    assert got[0]["fingerprint"] == got[200]["fingerprint"] and got[201]["near_next"] == 1.0
    assert got[203]["near_next"] < 1


def test_fingerprints_of_awkward_rows(spark):
    got = fingerprints.fingerprints(documents(ready(spark))).collect()
    assert len(got) == len(TEXTS)
    assert fingerprints.fingerprints(documents(spark, [])).count() == 0
    one = fingerprints.fingerprints(documents(spark, [(1, "just one text", None)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_kneser_ney_counts_and_what_is_left(spark):
    """Every count is found again, also many and those beyond a byte; what was dealt out is dropped."""
    rows = [(k, " ".join(random.Random(k).choices(["a", "b", "c", *map(str, range(300))], [900, 300, 100, *[1] * 300], k=60)), None) for k in range(200)]
    rows += [(1000 + k, "x y z", None) for k in range(300)]
    place = new_folder(ready(spark), "kn-test")
    before = set(Path(place.removeprefix("file:")).parent.iterdir())
    model = kneser_ney.train(documents(spark, rows), place, shards=5, order=3)
    left = [f for d in set(Path(place.removeprefix("file:")).parent.iterdir()) - before for f in d.rglob("*.parquet") if str(d) != model.folder]
    assert sum(f.stat().st_size for f in left) < 50_000
    want = collections.Counter()
    for _, text, _ in rows:
        own = kneser_ney.tokens(text.encode()).tolist()
        two = [int(kneser_ney.BEGIN)] * 2 + own
        want.update(zip(two, two[1:], own))
    grams = np.array(list(want), np.uint64)
    arrays = kneser_ney.Arrays(model)
    assert arrays.counts(kneser_ney._triple_key(*grams.T), "triples").tolist() == list(want.values())
    history = collections.defaultdict(list)
    for (a, b, _), n in want.items():
        history[a, b].append(n)
    keys = kneser_ney._key(*np.array(list(history), np.uint64).T)
    assert arrays.histories(keys).tolist() == [[sum(v), v.count(1), v.count(2), sum(n > 2 for n in v)] for v in history.values()]
    assert not arrays.counts(kneser_ney._triple_key(*(grams + np.uint64(1)).T), "triples").any() and max(want.values()) > 255
