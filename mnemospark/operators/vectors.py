"""Attaching embeddings to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialised

#: A user function from a batch of texts to their vectors.
Embed = Callable[[pd.Series], pd.Series]


def text_key(column: str):
    return F.sha2(F.col(column), 256)


class Embedded(NamedTuple):
    """``vectors``: text_key, embedding of the texts embedded now.

    ``failed``: the rows whose text could not be, with ``reason``; ``store``: all vectors known.
    """

    vectors: DataFrame
    failed: DataFrame
    store: DataFrame


def embed_missing(rows: DataFrame, store: DataFrame, embed: Embed, text: str = "content") -> Embedded:
    """Embed the texts of ``rows`` that ``store`` (text_key, embedding) does not hold yet.

    Texts are told apart by the hash of their content, so a text is embedded once
    however many rows have it, and never again while the store is kept. A batch that
    fails is taken text by text; a text that fails, or gets no vector, is reported with
    its reason and its rows, and stops no other. Null texts are not rows to embed.
    The vectors are written once, so the function is not called again by those who read them.
    """
    distinct = (
        rows.filter(F.col(text).isNotNull())
        .groupBy(text_key(text).alias("text_key"))
        .agg(F.first(text).alias("text"))
    )
    fresh = distinct.join(store.select("text_key"), "text_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, reasons = _embed_each(embed, batch["text"].reset_index(drop=True))
            yield pd.DataFrame({"text_key": batch["text_key"].to_numpy(), "embedding": vectors, "reason": reasons})

    done = materialised(fresh.mapInPandas(run, "text_key string, embedding array<float>, reason string"))
    vectors = done.filter(F.col("embedding").isNotNull()).select("text_key", "embedding")
    reasons = done.filter(F.col("embedding").isNull()).select("text_key", "reason")
    failed = rows.withColumn("text_key", text_key(text)).join(reasons, "text_key").drop("text_key")
    return Embedded(vectors, failed, store.select("text_key", "embedding").unionByName(vectors))


def _embed_each(embed: Embed, texts: pd.Series) -> tuple[list, list]:
    """Vectors and reasons of a batch; each text by itself if the batch as a whole fails."""
    try:
        found = list(embed(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
    except Exception as error:  # whatever the user's function raises
        if len(texts) == 1:
            return [None], [f"{type(error).__name__}: {error}"]
        parts = [_embed_each(embed, texts.iloc[n : n + 1].reset_index(drop=True)) for n in range(len(texts))]
        return [v for vs, _ in parts for v in vs], [r for _, rs in parts for r in rs]
    vectors, reasons = [], []
    for one in found:
        try:
            vector = [float(x) for x in one]
        except (TypeError, ValueError):
            vector = []
        vectors.append(vector or None)
        reasons.append(None if vector else "no vector")
    return vectors, reasons


def embed_distinct(rows: DataFrame, embed: Embed, text: str = "content") -> DataFrame:
    """Vectors (text_key, embedding) of the distinct texts, without a store to begin with."""
    nothing = rows.sparkSession.createDataFrame([], "text_key string, embedding array<float>")
    return embed_missing(rows, nothing, embed, text).vectors


def attach_embeddings(rows: DataFrame, vectors: DataFrame, text: str = "content") -> DataFrame:
    """Join vectors (text_key, embedding) to every row with that text.

    ``vectors`` has one row per text. A text shared by very many rows makes one
    join key heavy on the row side only, which AQE splits.
    """
    keyed = rows.withColumn("text_key", text_key(text))
    return keyed.join(vectors.select("text_key", "embedding"), "text_key", "left").drop("text_key")
