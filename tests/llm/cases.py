"""Small documents with every awkward case, and plain rules to compare with."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import types as T

PASSAGE = " ".join(f"passage{k} word{k * 7 % 31} tail{k}" for k in range(30))
PROSE = (
    "The river runs past the old mill and the children throw stones from the bridge while "
    "their mothers wait in the shade of the elms and talk about the price of bread."
)

TEXTS: list[tuple[int | None, str | None, str | None]] = [
    (1, PROSE, "en"),
    (2, PROSE, "en"),
    (3, PROSE.replace("stones", "pebbles"), "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \t\n ", "en"),
    (7, "Word", "en"),
    (8, "word", None),
    (9, "12 34 !! ²", "en"),
    (10, "Der alte Müller geht über die Brücke und grüßt die Kinder im Schatten der Bäume.", "de"),
    (11, "Die Mühle steht am Fluss und die Kinder werfen Steine über das Geländer.", "de"),
    (12, "Start here. " + PASSAGE + ". Something else follows in this one document only.", "en"),
    (13, "Another opening line altogether\n" + PASSAGE + "\nwith its very own ending after that.", "en"),
    (14, "ΑΣ Привет мир 日本語 ﬁ é İ <|endoftext|> x<|startoftext|> don't 'll", None),
    (15, "x" * 3000 + " y", "en"),
    (None, "A row without an id about the river and the mill.", "en"),
    (None, None, None),
    (16, "same id first text", "en"),
    (16, "same id second text, and longer", "en"),
    (17, "repeated row", "en"),
    (17, "repeated row", "en"),
    (18, "long " * 4000 + "end", "en"),
]

#: Names that operators use inside; they must not get in the way.
EXTRA = ["text_key", "key", "b", "row", "name", "n", "component", "words", "start", "ids", "count", "label", "toxic"]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in EXTRA],
    ]
)


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    full = [(i, t, g, "s", None if t is None else len(t), *["z"] * len(EXTRA)) for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> frozenset:
    found = [w for w in re.split("[\x20\x09-\x0d]+", lower(text or "")) if w]
    if len(found) < width:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[k : k + width]) for k in range(len(found) - width + 1))


def remainder(doc_id: int | None, divisor: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor


def by_rows(df, *columns):
    """Rows as sorted tuples; nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])
