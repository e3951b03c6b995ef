"""The Merkle manifest against a plain tree."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from mnemospark.llm import manifest
from mnemospark.llm.common import crc_is, ready
from tests.llm.cases import TEXTS, documents, remainder


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(digests):
    """Root, and the (left, right) siblings of every leaf from the bottom up."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for leaf, place in enumerate(at):
            run, inside = runs[place // 3], place % 3
            paths[leaf].append(("".join(run[:inside]), "".join(run[inside + 1 :])))
            at[leaf] = place // 3
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text -> sorted tuples of the query's columns."""
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        changed = text.replace("\n", "") if text is not None and remainder(doc_id, 2) == 0 else text
        trees[source].append((doc_id, leaf, plain_leaf(doc_id, source, lang, n_chars, changed)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        trees[source].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    grown = [plain_tree([leaf for _, leaf, _ in trees[s]]) for s in order]
    root, above = plain_tree([sub for sub, _ in grown])
    out = []
    for source, (sub, paths), up in zip(order, grown, above):
        for (doc_id, leaf, shown), path in zip(trees[source], paths):
            folded = shown
            for left, right in path + up:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in path + up))
            out.append((doc_id, leaf, sub, root, proof, folded, folded == root))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def proven(docs):
    shown = F.when(crc_is(2, 0), manifest.leaf_digest(text=F.translate("text", "\n", ""))).otherwise(manifest.leaf_digest())
    rows = manifest.proofs(manifest.build(docs, shown=shown)).select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")), manifest.fold(F.col("shown"), F.col("proof"))
    )
    return sorted(((*r, r[5] == r["root"]) for r in map(tuple_root, rows.collect())), key=lambda r: (r[0] is not None, r))


class tuple_root(tuple):
    def __getitem__(self, key):
        return super().__getitem__(3 if key == "root" else key)


def test_awkward_rows(spark):
    docs = documents(ready(spark)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("é"), F.col("doc_id") % 3)))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert len(rows) == len(TEXTS)
    assert proven(docs) == plain_manifest(rows)


def test_trees_of_many_shapes(spark):
    sizes = [1, 2, 3, 4, 9, 10, 28, 82]
    rows = [(100 * s + k, f"s{s}", None, k, f"line\n{k}" if k % 2 else None) for s in sizes for k in range(s)]
    docs = ready(spark).createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = proven(docs)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_lone_leaf_and_empty_table(spark):
    docs = documents(ready(spark), [(3, "a\nb", "en")])
    (row,) = proven(docs)
    assert row[1] == row[2] == row[3] and row[4] == sha("")
    assert proven(documents(spark, [])) == []
