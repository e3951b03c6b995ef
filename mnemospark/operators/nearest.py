"""Nearest memories by cosine similarity, for one request or a whole table.

``requests``: qid, user_id, project_id, embedding (and sequence).
``memories``: id, user_id, project_id, importance_score, embedding (and sequence).

Two exact routes give the same rows:

* few requests: they are broadcast (row and byte size checked first) and the
  memory table is scanned where it lies, without a shuffle;
* many requests: both sides are cut into blocks of bounded size by user (large
  users into several blocks) and every block pair is one co-grouped task.

Either way a task emits at most k matches per request, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.blocks import Block, MatchRule, keep_best, match_blocks
from mnemospark.operators.ranking import top_k_per_group
from mnemospark.schema import CANDIDATE_POOL
from mnemospark.session import BROADCAST_ROWS, broadcast_if_small, materialised

#: Limits under which the request table is broadcast to the executors.
BROADCAST_REQUESTS = 4096
BROADCAST_BYTES = 64 << 20
#: Rows of one block; 32,768 vectors of 1,024 floats are 128 MB.
MEMORY_BLOCK_ROWS = 32_768
REQUEST_BLOCK_ROWS = 4_096
#: Scopes (key and two counts: about 60 bytes) that may be broadcast as large.
LARGE_SCOPE_ROWS = 1_000_000
#: Scopes whose counts (with their names about 60 bytes) the driver may hold while it plans.
SCOPES_ON_DRIVER = 20_000
#: Matches a scanning task holds before it merges them.
HELD_MATCHES = 250_000


def live(memories: DataFrame) -> DataFrame:
    """Rows a vector search may return: positive stored score and a vector."""
    return memories.filter((F.col("importance_score") > 0.0) & F.col("embedding").isNotNull())


def missing_vectors(memories: DataFrame) -> DataFrame:
    """Per user: how many rows no search can reach for want of a vector."""
    return memories.groupBy("user_id").agg(
        F.count_if(F.col("embedding").isNull()).alias("without_vector"),
        F.count("*").alias("total"),
    )


def find_by_vector(
    memories: DataFrame,
    embedding: Sequence[float],
    user_id,
    project_id: str | None = None,
    limit: int = CANDIDATE_POOL,
) -> DataFrame:
    """One request: the best ``limit`` rows of a user, both filters in the scan."""
    scoped = memories.filter(F.col("user_id") == F.lit(user_id))
    if project_id:
        scoped = scoped.filter(F.col("project_id") == F.lit(project_id))
    request = memories.sparkSession.createDataFrame(
        [(0, [float(x) for x in embedding])], "qid int, embedding array<double>"
    ).withColumns(
        {
            "user_id": F.lit(user_id).cast(memories.schema["user_id"].dataType),
            "project_id": F.lit(None).cast("string"),
        }
    )
    columns = [c for c in memories.columns if c not in ("id", "embedding")]
    return nearest_memories(request, scoped, limit, columns=columns).drop("qid").orderBy("rank")


def nearest_memories(
    requests: DataFrame,
    memories: DataFrame,
    k: int = CANDIDATE_POOL,
    *,
    min_similarity: float | None = None,
    earlier_only: bool = False,
    cells: np.ndarray | None = None,
    broadcast_requests: int = BROADCAST_REQUESTS,
    columns: Sequence[str] = (),
    requests_stored: bool = False,
) -> DataFrame:
    """The ``k`` nearest live memories of every request: qid, id, similarity, rank.

    ``columns`` names further memory columns to attach to the matches.

    ``min_similarity`` keeps only matches at or above it; with ``cells`` it also
    leaves out cells that provably hold none. ``earlier_only`` compares the
    ``sequence`` columns and matches earlier rows only. ``requests_stored`` says that the
    requests are read from a stored table, so they need not be written once more.
    """
    rule = MatchRule(k, min_similarity, earlier_only)
    sequence = ["sequence"] if earlier_only else []
    wanted = requests.filter(F.col("embedding").isNotNull()).select(
        "qid", F.col("user_id").alias("scope"), "project_id", "embedding", *sequence
    )
    stored = live(memories).select(
        "id", F.col("user_id").alias("scope"), "project_id", "embedding", *sequence
    )
    few = _collect_if_few(wanted, broadcast_requests)
    if few is not None:
        partial = _scan_memories(_asked_for(stored, few), few, wanted.schema["qid"].dataType, rule)
    else:
        if cells is not None and min_similarity is not None:
            reach = cells_within(cells, _chord(min_similarity))
            wanted = _scoped(wanted.withColumn("cell", F.explode(reach("embedding"))), "cell")
            stored = _scoped(stored.withColumn("cell", nearest_cell(cells)("embedding")), "cell")
        partial = _join_blocks(wanted, stored, rule, requests_stored and cells is None)
    ranked = _final_ranks(partial, k)
    if not columns:
        return ranked
    payload = memories.select("id", "user_id", *(c for c in columns if c != "user_id"))
    if few is not None and few.num_rows * k <= BROADCAST_ROWS:
        ranked = F.broadcast(ranked)  # at most k rows for each request counted above
    else:
        users = broadcast_if_small(requests.select("user_id").distinct())
        payload = payload.join(users, "user_id", "left_semi")
    return payload.select("id", *columns).join(ranked, "id")


def nearest_memories_approx(
    requests: DataFrame,
    memories: DataFrame,
    cells: np.ndarray,
    probes: int,
    k: int = CANDIDATE_POOL,
) -> DataFrame:
    """Search only the ``probes`` cells nearest to each request.

    With as many probes as cells the result equals :func:`nearest_memories`.
    """
    wanted = requests.filter(F.col("embedding").isNotNull()).select(
        "qid", F.col("user_id").alias("scope"), "project_id", "embedding"
    )
    stored = live(memories).select("id", F.col("user_id").alias("scope"), "project_id", "embedding")
    return search_scopes(
        wanted.withColumn("cell", F.explode(cells_to_probe(cells, probes)("embedding"))),
        stored.withColumn("cell", nearest_cell(cells)("embedding")),
        k,
    )


def recall_report(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per request: how many of the exact matches the approximate search found."""
    found = approximate.select("qid", "id").withColumn("hit", F.lit(1))
    return (
        exact.select("qid", "id")
        .join(found, ["qid", "id"], "left")
        .groupBy("qid")
        .agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("expected"))
    )


def fit_cells(
    memories: DataFrame, n_cells: int = 100, fraction: float | None = None, seed: int = 7
) -> np.ndarray:
    """Centres of a coarse partition of the vector space.

    Trained on all live vectors, or on a ``fraction`` of them (by a hash of the
    id) where the caller asks for it. The centres themselves (n_cells vectors)
    are the only data that reach the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = live(memories).select("id", F.col("embedding").cast("array<double>").alias("v"))
    if fraction is not None:
        share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
        usable = usable.filter(share < int((1 << 40) * fraction))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    unit = usable.withColumn("length", length).filter(F.col("length") > 0.0)
    training = unit.select(
        array_to_vector(F.transform("v", lambda x: x / F.col("length"))).alias("features")
    )
    model = KMeans(k=n_cells, seed=seed, maxIter=10, initSteps=2).fit(materialised(training))
    return np.vstack(model.clusterCenters())


def _collect_if_few(wanted: DataFrame, max_rows: int) -> pa.Table | None:
    """The requests as an Arrow table, or None when they pass either limit."""
    if max_rows <= 0:
        return None
    table = wanted.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > BROADCAST_BYTES:
        return None
    return table


def _asked_for(stored: DataFrame, few: pa.Table) -> DataFrame:
    """Only rows of the users that ask, and of their projects if each request names one.

    The requests are few and known, so both are plain filters that reach the scan.
    """
    users = [u for u in few["scope"].unique().to_pylist() if u is not None]
    stored = stored.filter(F.col("scope").isin(users))
    projects = few["project_id"].unique().to_pylist()
    return stored.filter(F.col("project_id").isin(projects)) if all(projects) else stored


def _match_schema(qid: T.DataType, memory_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", qid),
            T.StructField("id", memory_id),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _scan_memories(
    stored: DataFrame, few: pa.Table, qid_type: T.DataType, rule: MatchRule
) -> DataFrame:
    """Scan the memories in place against broadcast requests."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, few.schema) as writer:
        writer.write_table(few)
    shared = stored.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        requests = Block.read(pa.ipc.open_stream(shared.value).read_all(), "qid")
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            memories = Block.read(pa.Table.from_batches([batch]), "id")
            for found in match_blocks(requests, memories, rule):
                held.append(found)
                rows += found.num_rows
            if rows > HELD_MATCHES:
                held = [keep_best(held, rule.k)]
                rows = held[0].num_rows
                if rows > HELD_MATCHES // 2:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from keep_best(held, rule.k).to_batches()

    return stored.mapInArrow(scan, _match_schema(qid_type, stored.schema["id"].dataType))


def _join_blocks(
    wanted: DataFrame, stored: DataFrame, rule: MatchRule, requests_stored: bool = False
) -> DataFrame:
    """Co-group bounded blocks of both sides.

    Scopes with more rows than a block are cut by a hash of the row id; each
    request block then meets each memory block. Scopes well below a block share
    buckets of about one block, so that no bucket grows far beyond it. Only
    scopes that are requested are shuffled.
    """
    wanted = wanted if requests_stored else materialised(wanted)
    asked = wanted.groupBy("scope").agg(F.count("*").alias("asked"))
    few = asked.limit(SCOPES_ON_DRIVER + 1).toArrow()
    if few.num_rows <= SCOPES_ON_DRIVER:
        stored, large, buckets = _blocks_of_few(stored, few)
    else:
        stored, large, buckets = _blocks_of_many(stored, asked)
    scope_hash = F.xxhash64("scope")
    bucket = F.when(F.col("m_blocks").isNull(), F.pmod(scope_hash, F.lit(buckets))).otherwise(
        scope_hash
    )

    def blocks(count: str) -> Column:
        return F.coalesce(F.col(count), F.lit(1))

    def own_block(row_id: str, count: str) -> Column:
        return F.pmod(F.xxhash64(row_id), blocks(count)).cast("int")

    def every_block(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(count) - 1))

    group = ["bucket", "m_block", "q_block"]
    left = (
        wanted.join(large, "scope", "left")
        .withColumns({"bucket": bucket, "q_block": own_block("qid", "q_blocks")})
        .withColumn("m_block", every_block("m_blocks"))
        .drop("m_blocks", "q_blocks")
    )
    right = (
        stored.join(large, "scope", "left")
        .withColumns({"bucket": bucket, "m_block": own_block("id", "m_blocks")})
        .withColumn("q_block", every_block("q_blocks"))
        .drop("m_blocks", "q_blocks")
    )
    # Fresh column identities: both sides may come from the same rows.
    left = left.select(*(F.col(c).alias(c) for c in left.columns))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    schema = _match_schema(wanted.schema["qid"].dataType, stored.schema["id"].dataType)

    def match(requests: pa.Table, memories: pa.Table) -> pa.Table:
        found = []
        if requests.num_rows and memories.num_rows:
            found = list(
                match_blocks(Block.read(requests, "qid"), Block.read(memories, "id"), rule)
            )
        if not found:
            return pa.table(
                {
                    "qid": requests["qid"].slice(0, 0),
                    "id": memories["id"].slice(0, 0),
                    "similarity": pa.array([], pa.float64()),
                }
            )
        return keep_best(found, rule.k)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(match, schema)


def _blocks_of_few(stored: DataFrame, asked: pa.Table) -> tuple[DataFrame, DataFrame, int]:
    """Rows of the asked scopes, the scopes of several blocks, and the number of buckets for the rest.

    The scopes and their two counts are few enough for the driver.
    """
    spark, kind = stored.sparkSession, stored.schema["scope"].dataType.simpleString()
    names = spark.createDataFrame([(scope,) for scope in asked["scope"].to_pylist()], f"scope {kind}")
    # Rows of other users are neither counted nor shuffled.
    stored = stored.join(F.broadcast(names), "scope", "left_semi")
    held = stored.groupBy("scope").agg(F.count("*").alias("held")).toArrow().to_pandas()
    sizes = asked.to_pandas().merge(held, on="scope")
    many = (sizes["held"] > MEMORY_BLOCK_ROWS // 8) | (sizes["asked"] > REQUEST_BLOCK_ROWS // 8)
    rows = [
        (scope, ceil(n / MEMORY_BLOCK_ROWS), ceil(q / REQUEST_BLOCK_ROWS))
        for scope, q, n in sizes[many][["scope", "asked", "held"]].itertuples(index=False)
    ]
    large = spark.createDataFrame(rows, f"scope {kind}, m_blocks int, q_blocks int")
    return stored, F.broadcast(large), _buckets(int(sizes["held"].sum()), int(sizes["asked"].sum()))


def _blocks_of_many(stored: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The same with all counts kept in tables."""
    stored = stored.join(broadcast_if_small(asked.select("scope")), "scope", "left_semi")
    held = stored.groupBy("scope").agg(F.count("*").alias("held"))
    sizes = materialised(asked.join(held, "scope"))
    large = sizes.filter(
        (F.col("held") > MEMORY_BLOCK_ROWS // 8) | (F.col("asked") > REQUEST_BLOCK_ROWS // 8)
    ).select(
        "scope",
        F.ceil(F.col("held") / MEMORY_BLOCK_ROWS).cast("int").alias("m_blocks"),
        F.ceil(F.col("asked") / REQUEST_BLOCK_ROWS).cast("int").alias("q_blocks"),
    )
    totals = sizes.agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).first()
    # Worth a larger broadcast: the alternative shuffles the vectors once more.
    large = broadcast_if_small(large, LARGE_SCOPE_ROWS)
    return stored, large, _buckets(totals["held"] or 0, totals["asked"] or 0)


def _buckets(held: int, asked: int) -> int:
    return max(1, ceil(held / MEMORY_BLOCK_ROWS), ceil(asked / REQUEST_BLOCK_ROWS))


def _final_ranks(partial: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(
        partial, ["qid"], [F.col("similarity").desc(), F.col("id")], k, split_on="id"
    )


def _chord(similarity: float) -> float:
    """Distance of two unit vectors at this cosine, with room for rounding."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * similarity))) + 1e-6


def _unit_matrix(vectors: pd.Series) -> np.ndarray:
    matrix = np.asarray(vectors.tolist(), dtype=np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _scoped(df: DataFrame, cell: str) -> DataFrame:
    """Replace the scope (user) by user and cell."""
    return df.withColumn("scope", F.concat_ws("\x1f", F.col(cell).cast("string"), "scope")).drop(
        cell
    )


def nearest_cell(cells: np.ndarray):
    """A function from vectors to the number of their nearest centre."""
    half_norms = 0.5 * np.einsum("ij,ij->i", cells, cells)

    @F.pandas_udf("int")
    def assign(vectors: pd.Series) -> pd.Series:
        return pd.Series((_unit_matrix(vectors) @ cells.T - half_norms).argmax(axis=1))

    return assign


def cells_to_probe(cells: np.ndarray, probes: int):
    """A function from vectors to the numbers of their ``probes`` nearest centres."""
    half_norms = 0.5 * np.einsum("ij,ij->i", cells, cells)

    @F.pandas_udf("array<int>")
    def probe(vectors: pd.Series) -> pd.Series:
        closeness = _unit_matrix(vectors) @ cells.T - half_norms
        order = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype(np.int32)))

    return probe


def cells_marked(cells: np.ndarray, names: np.ndarray, probes: int):
    """A function from vectors to the set of their ``probes`` nearest centres, a bit for each number in ``names``."""
    half_norms = 0.5 * np.einsum("ij,ij->i", cells, cells)

    @F.pandas_udf("binary")
    def mark(vectors: pd.Series) -> pd.Series:
        closeness = _unit_matrix(vectors) @ cells.T - half_norms
        order = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
        bits = np.zeros((len(order), int(names.max()) + 1), bool)
        np.put_along_axis(bits, names[order], True, axis=1)
        return pd.Series([row.tobytes() for row in np.packbits(bits, axis=1)])

    return mark


def cells_within(cells: np.ndarray, radius: float):
    """A function from vectors to all cells that can hold a unit vector within ``radius``.

    A vector of cell c' lies on the far side of the plane halfway between c' and the
    request's own cell, so a request further than ``radius`` from that plane has no match in c'.
    """
    half_norms = 0.5 * np.einsum("ij,ij->i", cells, cells)
    gaps = np.linalg.norm(cells[:, None, :] - cells[None, :, :], axis=2)

    @F.pandas_udf("array<int>")
    def reach(vectors: pd.Series) -> pd.Series:
        closeness = _unit_matrix(vectors) @ cells.T - half_norms
        own = closeness.argmax(axis=1)
        lead = closeness[np.arange(len(own)), own][:, None] - closeness
        reachable = lead <= radius * gaps[own] + 1e-9
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in reachable])

    return reach


def search_marked(wanted: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each request in the cells of its set; ``wanted`` is a stored table with ``probed``, ``stored`` has ``cell``."""
    # As with cells in the scope, rows without a user are of one user.
    user = F.concat_ws("\x1f", F.lit(""), F.col("scope").cast("string"))
    return _final_ranks(_join_blocks(wanted.withColumn("scope", user), stored.withColumn("scope", user), MatchRule(k), True), k)


def search_scopes(wanted: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each request over the cells it was copied to; both sides have scope and cell."""
    return _final_ranks(_join_blocks(_scoped(wanted, "cell"), _scoped(stored, "cell"), MatchRule(k)), k)
