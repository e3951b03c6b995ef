"""Near-dedup, components, passages and decontamination against plain loops."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import decontamination, linking, minhash, passages
from mnemospark.llm.common import ready
from mnemospark.llm.components import components
from mnemospark.session import shared_folder
from tests.llm.cases import PASSAGE, TEXTS, by_rows, documents, lower, shingles


def least(pairs, ids):
    """Smallest reachable id by repeated relaxing."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def grouped(rows, width):
    sets = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, set()).add(shingles(text, width))
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    pairs = [
        (i, j) for k, (i, s) in enumerate(flat) for j, t in flat[k + 1 :] if i != j and 100 * len(s & t) >= 80 * len(s | t)
    ]
    return least(pairs, sets)


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = least(edges, {x for e in edges for x in e})
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_rows():
    """Chains of edits, borderline pairs and a large group of near copies."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows, base = list(TEXTS), [word() for _ in range(60)]
    for k in range(60):
        own = list(base)
        for _ in range(draw.randrange(5)):
            own[draw.randrange(60)] = word()
        rows.append((100 + k, " ".join(own), "en"))
    chain = [word() for _ in range(50)]
    for k in range(30):
        chain[(7 * k) % 50] = word()
        rows.append((300 + k, " ".join(chain), "en"))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    got = minhash.near_duplicates(documents(ready(spark), rows), width=width).collect()
    assert len(got) == len(rows)
    root = grouped(rows, width)
    repeated = {16}
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert r["component_id"] is None and r["kept"]
        elif i not in repeated:
            assert (r["component_id"], r["kept"]) == (root[i], root[i] == i), i
    sizes = by_rows(minhash.near_duplicates(documents(spark), width=width), "doc_id", "n_shingles")
    want = [(i, len(shingles(t, width))) for i, t, _ in TEXTS]
    assert sizes == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_members_that_differ_in_different_places_make_no_pairs(spark):
    """One bucket around a hub with which few are linked; some members have a near copy of their own."""
    draw = random.Random(5)
    base, pool = list(range(1, 148)), list(range(1000, 1400))
    spread = lambda k: (k * 0x9E3779B97F4A7C15) % (1 << 64)
    other = lambda own, n: set(draw.sample(sorted(own), len(own) - n)) | set(draw.sample(pool, n))
    sets = {0: set(base)}
    for k in range(1, 121):
        sets[k] = other(sets[0], 25)
        if k % 6 == 0:
            sets[1000 + k] = other(sets[k], 3)
    rows = [(i, np.sort(np.array([spread(x) for x in own], np.uint64)).tobytes(), len(own)) for i, own in sets.items()]
    ready(spark)
    table = spark.createDataFrame([(i, bytearray(b), n) for i, b, n in rows], "id long, shingles binary, n long")
    compared = []

    def likely(pairs):
        compared.append(pairs.count())
        return pairs

    active = table.select(F.lit(7).cast("long").alias("key"), "id", F.col("n"))
    got = {r["id"]: r["component"] for r in linking.link(active, table.select("id", "shingles"), likely).collect()}
    flat = sorted(sets.items())
    links = [(i, j) for k, (i, s) in enumerate(flat) for j, t in flat[k + 1 :] if 100 * len(s & t) >= 80 * len(s | t)]
    want = least(links, sets)
    assert len(links) >= 20 and got == {i: want[i] for i in {x for e in links for x in e}}
    # Hub and members make one pair each; members make next to none among themselves.
    assert sum(compared) < 4 * len(sets), compared


def test_pruning_keeps_likely_pairs():
    bounds = minhash.prune_bounds(200)
    assert [n for n, _ in bounds] == [40, 80, 120, 160, 200]
    assert all(0 < m < 0.8 * n for n, m in bounds)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(ready(spark), [])).count() == 0
    only_null = documents(spark, [(1, None, None), (2, "", None)])
    assert by_rows(minhash.near_duplicates(only_null), "doc_id", "component_id", "kept") == [(1, 1, True), (2, 2, True)]


def test_passages(spark):
    docs = documents(ready(spark))
    found = passages.repeated_passages(docs).collect()
    texts = {i: t for i, t, _ in TEXTS}
    mine = {r["doc_id"]: r for r in found}
    assert 13 in mine and mine[13]["first_doc_id"] == 12
    cut = texts[13].encode()[mine[13]["start"] : mine[13]["stop"]].decode()
    assert cut in texts[13] and len(cut.split()) >= 60 and set(cut.split()) <= set(PASSAGE.split())
    assert not {4, 5, 6, 7, 9, 10, 11, 12, 14, 15, None} & set(mine)
    left = {(r["doc_id"], r["text"]): r for r in passages.remove_passages(docs, passages.repeated_passages(docs)).collect()}
    assert len(left) == len(set((i, t) for i, t, _ in TEXTS))
    changed = [t for (i, t) in left if i == 13][0]
    assert changed == texts[13].replace(cut, "")
    assert left[13, changed]["n_chars"] == len(changed) and left[13, changed]["key"] == "z"
    assert (10, texts[10]) in left and (4, None) in left


def test_passages_in_the_middle_of_lines(spark):
    """Passages of over 50 words at any place; documents without one stay."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(5))
    passage = [[word() for _ in range(70)] for _ in range(8)]
    rows = []
    for k in range(48):
        own = [word() for _ in range(150)]
        if k % 2:
            at = draw.randrange(150)
            own[at:at] = passage[k % 8]
        rows.append((k, " ".join(own), "en"))
    found = {r["doc_id"] for r in passages.repeated_passages(documents(ready(spark), rows)).collect()}
    first = {k % 8: k for k in reversed(range(48)) if k % 2}
    assert found == {k for k in range(48) if k % 2 and k != first[k % 8]}


def long_rows(edit):
    """Passages of 51 to 60 words inside lines, and stretches of up to 50; the plain spans of the former."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(6))
    rows, want = [], {}
    for k in range(60):
        size = 51 + k % 10 if k < 40 else 40 + k % 11
        passage = [word() for _ in range(size)]
        for copy in (0, 1):
            own, at = [word() for _ in range(120)], draw.randrange(1, 119)
            used = list(passage)
            if copy and edit:
                used[size // 2] = word()
            rows.append((2 * k + copy, " ".join(own[:at] + used + own[at:]), "en"))
            if copy and k < 40:
                want[2 * k + 1] = (" ".join(used), size, 2 * k)
    # 50 words of two passages in the least document, one word more in the next: only the other two share 51.
    passage = [word() for _ in range(51)]
    for k, own in enumerate((passage[:50], passage, passage)):
        rows.append((200 + k, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)]), "en"))
    want[202] = (" ".join(passage), 51, 201)
    return rows, want


@pytest.mark.parametrize("edit", [False, True])
def test_passages_of_51_to_60_words(spark, edit):
    rows, want = long_rows(edit)
    texts = {i: t.encode() for i, t, _ in rows}
    got = passages.repeated_passages(documents(ready(spark), rows)).collect()
    found = {r["doc_id"]: (texts[r["doc_id"]][r["start"] : r["stop"]].decode(), r["n_words"], r["first_doc_id"]) for r in got}
    # The begin of its passage, up to 50 words, is kept by 200 and by 201, the whole by 201.
    if found[202][2] == 200:
        found[202] = (*found[202][:2], 201)
    assert found == want
    assert len(got) == len(want)


def test_passages_kept_in_halves(spark):
    """Two documents hold the halves of a passage, two later ones the whole, one of them with another word."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(6))
    rows, want = [], {}
    for k in range(0, 240, 4):
        passage = [word() for _ in range(70)]
        changed = [*passage[:20], word(), *passage[21:]]
        for n, own in enumerate((passage[:35], passage[35:], passage, changed)):
            at = draw.randrange(1, 79)
            other = [word() for _ in range(80)]
            rows.append((k + n, " ".join(other[:at] + own + other[at:]), "en"))
            if n > 1:
                want[k + n] = " ".join(own)
    texts = {i: t.encode() for i, t, _ in rows}
    got = passages.repeated_passages(documents(ready(spark), rows)).collect()
    found = {r["doc_id"]: texts[r["doc_id"]][r["start"] : r["stop"]].decode() for r in got}
    assert all(found[i] == want[i] for i in want if i % 4 == 2) and set(found) <= set(want)
    # With another word a whole paragraph must be left of each half; that is likely, not certain.
    assert sum(found.get(i) == want[i] for i in want if i % 4 == 3) >= 57


def plain_windows(rows, size):
    """Words of each text that lie in a window that an earlier document has."""
    seen, out = {}, {}
    for i, text, _ in rows:
        words = text.lower().split()
        for k in range(len(words) - size + 1):
            seen.setdefault(" ".join(words[k : k + size]), set()).add(i)
    for i, text, _ in rows:
        words = text.lower().split()
        for k in range(len(words) - size + 1):
            if min(seen[" ".join(words[k : k + size])]) < i:
                out.setdefault(i, set()).update(range(k, k + size))
    return out


def test_every_exact_repeat_is_found(spark):
    """Texts put together from shared pieces of any length: each window that repeats is inside a passage."""
    draw = random.Random(17)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    pool = [word() for _ in range(600)]
    rows = []
    for i in range(150):
        own = []
        while len(own) < 160:
            if draw.random() < 0.5:
                at = draw.randrange(560)
                own += pool[at : at + draw.randrange(20, 90)]
            else:
                own += [word() for _ in range(draw.randrange(1, 60))]
        rows.append((i, " ".join(own), "en"))
    want = plain_windows(rows, 51)
    texts = {i: t.encode() for i, t, _ in rows}
    got = {}
    for r in passages.repeated_passages(documents(ready(spark), rows)).collect():
        before = len(texts[r["doc_id"]][: r["start"]].split())
        got.setdefault(r["doc_id"], set()).update(range(before, before + r["n_words"]))
        assert r["n_words"] >= 51 and r["first_doc_id"] < r["doc_id"]
    assert len(want) > 50 and all(places <= got.get(i, set()) for i, places in want.items())


def test_lone_paragraphs_go_no_further(spark):
    """Only paragraphs that equal or meet another leave their block, whichever blocks the two are in."""
    draw = random.Random(17)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(6))
    shared = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(60):
        own = [word() for _ in range(90)]
        rows.append((k, " ".join(own[:45] + (shared[k // 2] if k < 12 else []) + own[45:]), "en"))
    docs = documents(ready(spark), rows).repartition(3, "doc_id")
    packed = passages.materialised(passages._packed(docs, passages.LEAST_WORDS))
    assert packed.select("block").distinct().count() == 3
    got = passages._met(packed).collect()
    texts = {i: t.split() for i, t, _ in rows}
    places = {}
    for i, own in texts.items():
        hashed = passages.hashes(" ".join(own).encode())
        stops = passages.cuts(hashed, np.array([len(hashed)])).tolist()
        for start, stop in zip([0, *stops], stops):
            places.setdefault(" ".join(own[start:stop]), set()).add((i, start, stop))
    several = {p for found in places.values() if len(found) > 1 for p in found}
    found = {(r["doc_id"], r["start"], r["stop"]) for r in got}
    assert several <= found and len(several) >= 36
    # The rest share a shingle over a cut, of the shared stretches.
    assert {i for i, _, _ in found} == set(range(12)) and len(found) < len(several) + 24
    assert all(r["m0"] is not None for r in got if (r["doc_id"], r["start"], r["stop"]) in several and r["n"] > 0)


def test_cuts_of_texts_together():
    """Texts that are cut together are cut as each by itself."""
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 50, n).astype(np.uint64) for n in (1, 17, 18, 19, 20, 300, 2, 77, 1, 500)]
    ends = np.cumsum([len(x) for x in texts])
    alone = [passages.cuts(x, np.array([len(x)])) + end - len(x) for x, end in zip(texts, ends)]
    assert passages.cuts(np.concatenate(texts), ends).tolist() == np.concatenate(alone).tolist()


def test_windows_of_common_phrases(spark):
    """A phrase of 30 words in many documents makes no windows; one of 55 in two makes theirs."""
    draw = random.Random(23)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(6))
    phrase, longer = [word() for _ in range(30)], [word() for _ in range(55)]
    rows = []
    for k in range(42):
        own = [word() for _ in range(80)]
        rows.append((k, " ".join(own[:40] + (longer if k >= 40 else phrase) + own[40:]), "en"))
    docs = documents(ready(spark), rows)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    around = passages.materialised(keyed.select("doc_id", "text_key", F.lit(50).alias("start"), F.lit(60).alias("stop")))
    hits, (samples, _, windows) = passages._exact(around, keyed, 51)
    assert sorted((r["doc_id"], r["s"], r["e"], r["first"]) for r in hits.collect()) == [(41, s, s + 51, 40) for s in range(40, 45)]
    # 42 windows of 42 documents lie around the paragraphs.
    assert windows.count() < 42 * 42 // 2 and samples.count() < 42 * 42 // 3


def test_run_ends_as_arrays():
    """Ends compared many at once are where each by itself is, or are left to be looked at by themselves."""
    draw = np.random.default_rng(8)
    texts = [draw.integers(0, 3, n).astype(np.uint64) for n in (0, 5, 40, 90)]
    hashed, ends = np.concatenate(texts), np.cumsum([len(x) for x in texts])
    left = 0
    for _ in range(400):
        k = int(draw.integers(len(texts)))
        own, begin = texts[k], ends[k] - len(texts[k])
        edge, past = int(draw.integers(len(own) + 1)), bool(draw.integers(2))
        theirs = draw.integers(0, 3, int(draw.integers(passages.AHEAD + 1))).astype(np.uint64)
        if draw.integers(2):
            mine = own[edge:] if past else own[:edge][::-1]
            theirs = np.concatenate([mine[: draw.integers(30)], theirs])[: passages.AHEAD]
        size = len(own) - edge if past else edge
        same, seen, open_ = (
            x[0]
            for x in passages._compared(
                hashed, np.array([begin + edge]), np.array([past]), np.array([size]), theirs, np.array([0]), np.array([len(theirs)])
            )
        )
        want = passages._end(own, theirs, {"s": edge, "e": edge, "side": 1 if past else -1}, 80)
        left += open_
        assert open_ or (edge + same if past else edge - same, seen) == want
    assert 0 < left < 400


def test_passages_leave_no_tables_behind(spark):
    """What only the work on run ends and windows needs is dropped when they are done."""
    rows, want = long_rows(True)
    place = Path(shared_folder(ready(spark)).removeprefix("file:"))
    before = set(place.iterdir())
    assert passages.repeated_passages(documents(spark, rows)).count() == len(want)
    left = [set(spark.read.parquet(str(f)).columns) for f in set(place.iterdir()) - before]
    assert left and not any(c & {"ahead", "done", "side", "parts"} or {"w", "s"} <= c for c in left)


def test_passages_of_nothing(spark):
    docs = documents(ready(spark), [])
    assert passages.remove_passages(docs, passages.repeated_passages(docs)).count() == 0


ITEMS = [
    (1, "The children throw stones from the bridge while their mothers wait in the shade of the elms"),
    (2, "repeated ROW"),
    (3, "mill"),
    (4, None),
    (5, "!!"),
    (6, "Repeated row"),
    (None, "brücke und"),
    (7, "never anywhere in these documents at all"),
]


def judged(text, items):
    of = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or "")) if w]
    own, hit, names = of(text), set(), set()
    for item, t in items:
        w = of(t)
        n = min(13, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(own) - n + 1) if w else ():
            if tuple(own[k : k + n]) in windows:
                hit.update(range(k, k + n))
                names.add(item)
    return len(own), len(hit), len({n for n in names if n is not None}), len(hit) > 0 and 20 * len(hit) >= len(own)


def test_contamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = by_rows(decontamination.contamination(documents(ready(spark)), items), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    want = [(i, *judged(t, ITEMS)) for i, t, _ in TEXTS]
    assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(documents(ready(spark), []), items).count() == 0
    none = decontamination.contamination(documents(spark), items.where("false"))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(TEXTS)
