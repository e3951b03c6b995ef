"""Best matches between a block of requests and a block of memories.

Runs inside Spark tasks on Arrow tables. A block may hold many scopes (users,
or users and cells); only rows of equal scope are compared. The product of the
two vector blocks is taken tile by tile and cut to ``k`` matches per request at
once, so pairs are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

REQUEST_TILE = 256
MEMORY_TILE = 4096
#: Similarities are ranked at this many decimals, so that equal vectors tie
#: (and fall back to the id order) wherever in a block they are placed.
SIMILARITY_DECIMALS = 12


@dataclass(frozen=True)
class MatchRule:
    """What counts as a match."""

    k: int
    floor: float | None = None
    earlier_only: bool = False


@dataclass
class Block:
    ids: pa.Array
    scope: np.ndarray
    project: np.ndarray
    sequence: np.ndarray | None
    unit: np.ndarray
    #: Of memories the cell, of requests the cells they look into: a bit for each cell.
    cell: np.ndarray | None = None
    probed: np.ndarray | None = None

    @classmethod
    def read(cls, table: pa.Table, id_column: str) -> Block:
        """Rows in id order with unit vectors; rows without a direction are left out."""
        table = table.combine_chunks().sort_by(id_column)
        lengths = pc.list_value_length(table["embedding"]).to_numpy()
        if len(lengths) and (lengths != lengths[0]).any():
            raise ValueError("embeddings of different dimensions cannot be compared")
        values = pc.list_flatten(table["embedding"]).to_numpy().astype(np.float64)  # a copy
        width = int(lengths[0]) if len(lengths) else 1
        vectors = values.reshape(-1, width)
        lengths_l2 = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        usable = np.flatnonzero(np.isfinite(lengths_l2) & (lengths_l2 > 0))
        # The vectors are held once, at full precision; the other columns are short.
        table = table.drop_columns(["embedding"]).take(pa.array(usable))
        if len(usable) < len(vectors):
            vectors, lengths_l2 = vectors[usable], lengths_l2[usable]
        vectors /= lengths_l2[:, None]
        sequence = table["sequence"].to_numpy() if "sequence" in table.column_names else None
        return cls(
            ids=_flat(table[id_column]),
            scope=table["scope"].to_pandas().to_numpy(),
            project=table["project_id"].to_pandas().to_numpy(dtype=object),
            sequence=sequence,
            unit=vectors,
            cell=table["cell"].to_numpy() if "cell" in table.column_names else None,
            probed=_bits(table["probed"]) if "probed" in table.column_names else None,
        )

    def rows_by_scope(self) -> dict:
        codes, scopes = pd.factorize(self.scope)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(scopes) + 1))
        return {s: order[bounds[i] : bounds[i + 1]] for i, s in enumerate(scopes)}


def _flat(column: pa.ChunkedArray) -> pa.Array:
    flat = column.combine_chunks()
    return pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    """Sets of cells, all of one size, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _first_k(request, memory, similarity, k):
    order = np.lexsort((memory, -similarity, request))
    request, memory, similarity = request[order], memory[order], similarity[order]
    starts = np.searchsorted(request, request, side="left")
    keep = np.arange(len(request)) - starts < k
    return request[keep], memory[keep], similarity[keep]


def _match_scope(requests: Block, memories: Block, q_rows, m_rows, rule: MatchRule):
    """Best ``k`` (request row, memory row, similarity) within one scope."""
    wanted = requests.project[q_rows]
    any_project = pd.isna(wanted) | (wanted == "")
    codes, _ = pd.factorize(np.concatenate([wanted, memories.project[m_rows]]))
    q_code, m_code = codes[: len(q_rows)], codes[len(q_rows) :]
    unscoped = bool(any_project.all())
    for q_lo in range(0, len(q_rows), REQUEST_TILE):
        q_tile = q_rows[q_lo : q_lo + REQUEST_TILE]
        q_unit = requests.unit[q_tile]
        probed = None if requests.probed is None else np.unpackbits(requests.probed[q_tile], axis=1).astype(bool)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for m_lo in range(0, len(m_rows), MEMORY_TILE):
            m_tile = m_rows[m_lo : m_lo + MEMORY_TILE]
            score = q_unit @ memories.unit[m_tile].T
            if not unscoped:
                visible = any_project[q_lo : q_lo + REQUEST_TILE, None] | (
                    q_code[q_lo : q_lo + REQUEST_TILE, None]
                    == m_code[None, m_lo : m_lo + MEMORY_TILE]
                )
                score[~visible] = -np.inf
            if probed is not None:
                score[~probed[:, memories.cell[m_tile]]] = -np.inf
            if rule.earlier_only:
                later = memories.sequence[m_tile][None, :] >= requests.sequence[q_tile][:, None]
                score[later] = -np.inf
            # The margin keeps everything that could still tie after rounding.
            bar = np.full(len(q_tile), -2.0 if rule.floor is None else rule.floor - 1e-9)
            above = score >= bar[:, None]
            if np.count_nonzero(above) > 4 * rule.k * len(q_tile) and score.shape[1] > rule.k:
                cut = score.shape[1] - rule.k
                bar = np.maximum(bar, np.partition(score, cut, axis=1)[:, cut] - 1e-9)
                above = score >= bar[:, None]
            q_at, m_at = np.nonzero(above)
            similarity = np.round(score[q_at, m_at], SIMILARITY_DECIMALS)
            if rule.floor is not None:
                near = similarity >= rule.floor
                q_at, m_at, similarity = q_at[near], m_at[near], similarity[near]
            best = _first_k(
                np.concatenate([best[0], q_tile[q_at]]),
                np.concatenate([best[1], m_tile[m_at]]),
                np.concatenate([best[2], similarity]),
                rule.k,
            )
        yield best


def match_blocks(requests: Block, memories: Block, rule: MatchRule) -> Iterator[pa.Table]:
    """Tables (qid, id, similarity), at most ``k`` rows per request and scope."""
    by_scope = requests.rows_by_scope()
    for scope, m_rows in memories.rows_by_scope().items():
        q_rows = by_scope.get(scope)
        if q_rows is None:
            continue
        for q_at, m_at, similarity in _match_scope(requests, memories, q_rows, m_rows, rule):
            if len(q_at):
                yield pa.table(
                    {
                        "qid": requests.ids.take(pa.array(q_at)),
                        "id": memories.ids.take(pa.array(m_at)),
                        "similarity": similarity,
                    }
                )


def keep_best(tables: list[pa.Table], k: int) -> pa.Table:
    """Merge match tables and cut them to ``k`` rows per request."""
    merged = pa.concat_tables(tables).sort_by(
        [("qid", "ascending"), ("similarity", "descending"), ("id", "ascending")]
    )
    codes = pc.rank(merged["qid"], tiebreaker="min").to_numpy()
    keep = np.arange(1, len(codes) + 1) - codes < k
    return merged.filter(pa.array(keep))
