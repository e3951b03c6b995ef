"""A table of memories kept in coarse cells, for approximate searches that read little.

Folder layout: ``rows/cell=N`` holds the memories of a cell, ``versions/version=V`` the centres
that are in use (cell, centre, since). The number of a cell is stored with its rows on
write; a search looks at the centres, chooses the nearest cells and reads those
partitions alone. New rows go to the nearest centre without touching others. A
cell that has grown too full is split into new cells: only its own rows are read and
written again, then a new version of the centres is written, which is what makes
the new cells visible and the old one not.

Centres are few (their number times the dimension), so driver and tasks hold them all.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.nearest import cells_marked, cells_to_probe, fit_cells, live, nearest_cell, search_marked, search_scopes
from mnemospark.schema import CANDIDATE_POOL
from mnemospark.session import broadcast_if_small, materialised

#: Memories of a cell beyond which it is split, unless the caller says otherwise.
FULL = 1_000_000

#: Requests that look into more than this share of the cells are not copied to each, but carry the set of them.
SPARSE = 0.25

#: Requests that the number of cells to look into is fitted on.
FITTED_ON = 1_000


def create_cell_table(memories: DataFrame, path: str, n_cells: int, fraction: float | None = None) -> None:
    """Fit centres and write all memories; those without a usable vector are not kept here."""
    centres = fit_cells(memories, n_cells, fraction)
    _write_rows(memories, centres, np.arange(len(centres)), path)
    _write_version(memories.sparkSession, path, 0, np.arange(len(centres)), centres)


def append_to_cells(rows: DataFrame, path: str) -> None:
    """Add memories to the cells of their nearest centres."""
    cells, centres, _ = _centres(rows.sparkSession, path)
    _write_rows(rows, centres, cells, path)


def split_full_cells(spark: SparkSession, path: str, full: int = FULL) -> list[int]:
    """Split every cell with more than ``full`` memories; the numbers of the cells split.

    A cell becomes as many as would bring it below the limit. Its rows are read by its
    partition and written under new numbers; no other row is looked at.
    """
    cells, centres, version = _centres(spark, path)
    rows = _rows(spark, path)
    counts = rows.filter(F.col("cell").isin(cells.tolist())).groupBy("cell").count()
    large = {r["cell"]: r["count"] for r in counts.filter(F.col("count") > full).collect()}
    number = int(_rows(spark, path).select("cell").distinct().agg(F.max("cell")).first()[0] or 0) + 1 if large else 0
    for cell, n in sorted(large.items()):
        own = rows.filter(F.col("cell") == cell).drop("cell")
        parts = fit_cells(own, max(2, ceil(n / full)))
        names = np.arange(number, number + len(parts))
        _write_rows(own, parts, names, path)
        keep = cells != cell
        cells = np.concatenate([cells[keep], names])
        centres = np.vstack([centres[keep], parts])
        number += len(parts)
    if large:
        _write_version(spark, path, version + 1, cells, centres)
    return sorted(large)


def search_cells(
    requests: DataFrame, path: str, probes: int, k: int = CANDIDATE_POOL
) -> DataFrame:
    """The best ``k`` memories of each request among those in its ``probes`` nearest cells.

    With as many probes as cells the result is exact. Columns: qid, id, similarity, rank.
    """
    spark = requests.sparkSession
    cells, centres, _ = _centres(spark, path)
    wanted = requests.filter(F.col("embedding").isNotNull()).select(
        "qid", F.col("user_id").alias("scope"), "project_id", "embedding"
    )
    if probes > SPARSE * len(cells):
        wanted = materialised(wanted.withColumn("probed", cells_marked(centres, cells, probes)("embedding")))
        return search_marked(wanted, _stored(spark, path, cells.tolist()), k)
    names = F.array(*[F.lit(int(c)) for c in cells])
    wanted = materialised(
        wanted.withColumn("at", F.explode(cells_to_probe(centres, probes)("embedding")))
        .withColumn("cell", F.get(names, F.col("at")))
        .drop("at")
    )
    # At most as many numbers as there are cells; they are the partitions that are read.
    asked = [r["cell"] for r in wanted.select("cell").distinct().collect()]
    return search_scopes(wanted, _stored(spark, path, asked), k)


def fit_probes(
    requests: DataFrame, path: str, recall: float = 0.9, k: int = CANDIDATE_POOL, fitted_on: int = FITTED_ON
) -> int:
    """The least number of cells to look into, doubling, that finds the share ``recall``.

    Measured on ``fitted_on`` requests, chosen by a hash of qid, against a search of all cells.
    One search tells for all numbers: a match is found as soon as its own cell is looked into.
    """
    spark = requests.sparkSession
    cells, centres, _ = _centres(spark, path)
    some = materialised(requests.orderBy(F.xxhash64("qid")).limit(fitted_on))
    exact = materialised(search_cells(some, path, len(cells), k).groupBy("qid", "id").count())
    kept = _stored(spark, path, cells.tolist()).join(broadcast_if_small(exact.select("id").distinct()), "id", "left_semi")
    at = F.array_position(F.array(*[F.lit(int(c)) for c in cells]), F.col("cell")) - 1
    ways = some.filter(F.col("embedding").isNotNull()).select("qid", cells_to_probe(centres, len(cells))("embedding").alias("way"))
    # An id that several cells keep is found with the first of them.
    needed = (
        exact.join(kept.select("id", at.cast("int").alias("at")).distinct(), "id").join(ways, "qid")
        .groupBy("qid", "id").agg(F.min(F.array_position("way", F.col("at"))).alias("probes"), F.max("count").alias("count"))
        .groupBy("probes").agg(F.sum("count").alias("count"))
    )
    needed = {r["probes"]: r["count"] for r in needed.collect()}
    expected, probes = exact.agg(F.sum("count")).first()[0] or 0, 1
    while probes < len(cells):
        if sum(n for least, n in needed.items() if least <= probes) >= recall * expected:
            return probes
        probes *= 2
    return len(cells)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def _stored(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """What a search reads of these cells."""
    return live(_rows(spark, path).filter(F.col("cell").isin(cells))).select(
        "id", F.col("user_id").alias("scope"), "project_id", "embedding", "cell"
    )


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers and centres of the cells in use, and their version."""
    known = spark.read.schema("cell int, centre array<double>, version int").parquet(f"{path}/versions")
    latest = known.agg(F.max("version")).first()[0]
    rows = sorted((r["cell"], r["centre"]) for r in known.filter(F.col("version") == latest).collect())
    return np.array([c for c, _ in rows]), np.array([v for _, v in rows]), latest


def _write_version(spark: SparkSession, path: str, version: int, cells: np.ndarray, centres: np.ndarray) -> None:
    table = pd.DataFrame({"cell": cells.tolist(), "centre": centres.tolist()})
    rows = spark.createDataFrame(table, "cell int, centre array<double>").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/versions/version={version}")


def _write_rows(rows: DataFrame, centres: np.ndarray, names: np.ndarray, path: str) -> None:
    numbers = F.array(*[F.lit(int(c)) for c in names])
    kept = rows.filter(F.col("embedding").isNotNull())
    placed = kept.withColumn("cell", F.get(numbers, nearest_cell(centres)("embedding")))
    # Cells are brought together first, those with much in several tasks: each task would write a file for each cell.
    placed = placed.hint("rebalance", F.col("cell"))
    placed.sortWithinPartitions("cell", "user_id").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
