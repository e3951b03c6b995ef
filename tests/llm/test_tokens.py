"""BPE coding, token counts and the token store against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mnemospark.llm import bpe, token_counts, token_store
from mnemospark.llm.common import ready
from mnemospark.session import new_folder
from tests.llm.cases import TEXTS, by_rows, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_of_any_shape(library):
    draw = random.Random(5)
    alphabet = "aeinrst'’.,-01²é ßÉ\n\t\x1c\x85\xa0<|>ΣИ日́"
    made = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(80))) for _ in range(400)]
    made += ["ab" * 400, "é" * 300, "<|endoftext|><|endoftext|>", "a<|startoftext|>b", "'s't're"]
    coder = bpe.load(bpe.default_path())
    for text, ids in zip(made, coder.encode_batch(made)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text), repr(text)


def test_cuts_are_certain(library):
    coder = bpe.load(bpe.default_path())
    assert not coder.joined.all()
    for token in coder.vocabulary:
        body = [coder.byte_of[c] for c in token.removesuffix(coder.suffix)]
        assert coder.joined[body[:-1], body[1:]].all()


def test_encode_and_decode(spark, library):
    got = by_rows(bpe.decode(bpe.encode(documents(ready(spark)))), "doc_id", "ids", "decoded")
    want = []
    for doc_id, text, _ in TEXTS:
        ids = ids_of(library, text)
        want.append((doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is not None, r[0] or 0, bytes(r[1]))
    assert sorted([(a, bytes(b), c) for a, b, c in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [0, 5, 1000])
def test_counts_do_not_depend_on_the_table(spark, library, size):
    got = by_rows(token_counts.count_tokens(documents(ready(spark)), size=max(size, 1)), "doc_id", "n_bytes", "n_tokens")
    want = [(i, len((t or "").encode()), len(ids_of(library, t))) for i, t, _ in TEXTS]
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_store(spark, library):
    folder = new_folder(ready(spark), "store-test")
    token_store.write(documents(spark), folder, shards=3)
    rows = token_store.read(spark, folder).collect()
    assert len(rows) == len(TEXTS)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([i for i, _, _ in TEXTS], key=lambda i: (i is not None, i or 0))
    start = 0
    texts = {}
    for doc_id, text, _ in TEXTS:
        texts.setdefault(doc_id, []).append([*ids_of(library, text), 2])
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert row["start"] == start and row["n_tokens"] == len(ids) and ids in texts[row["doc_id"]]
        start += len(ids)
    lookup = token_store.Lookup(folder)
    for doc_id in (1, 7, 15, 18):
        assert lookup.get(doc_id).tolist() == texts[doc_id][0]
    assert lookup.get(16).tolist() in texts[16]
    assert lookup.get(999) is None and lookup.get(-3) is None
    keys = spark.createDataFrame([(3,), (None,), (10**9,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_store.with_lookup(keys, folder).collect()}
    assert found[None] is None and found[10**9] is None
    assert zlib.crc32(bytes(found[3])) == zlib.crc32(np.array(texts[3][0], "<u4").tobytes())


def test_perfect_hash():
    for n in (1, 2, 5, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n, dtype=np.uint64))
        slots = token_store.perfect_slots(keys, token_store.perfect_hash(keys), len(keys))
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_empty_table(spark):
    none = documents(ready(spark), [])
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    folder = new_folder(spark, "store-test")
    assert token_store.write(none, folder) == []
    assert token_store.read(spark, folder).count() == 0


