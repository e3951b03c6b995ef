"""Whitening of embeddings by an eigendecomposition that is kept up to date row by row.

* Every task starts from an empty spectrum and adds its vectors one by one: a centred
  rank-one update of the scatter matrix, whose new eigenvalues are the roots of a secular
  equation. Entries that take no part (no weight, or equal eigenvalues, turned into one)
  are deflated.
* Spectra of tasks are combined in a tree: the eigenpairs of one are rank-one updates of the
  other, and the distance of the means is one more.
* The result is a basis in which a second pass sums the covariance, centred by the exact
  means (Rayleigh-Ritz); its small eigenproblem gives the components. A third pass
  measures how far the whitened covariance is from the identity.

State is bounded by the dimension alone: a task and the driver hold a few square matrices.

Entries c become long x = floor(64 c); a common shift of all x changes nothing.

Defined results: null vectors and vectors with a null or non-finite entry, or one of 2^46 or
more, are dropped, and so are those that have not the most frequent length (of two
equally frequent, the larger). Rows without vec_id and repeated rows count like any other.
An empty table has no rows. A direction without variance has null ``whitened`` values.
``deviation`` is null where it exceeds a long. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import map_batches
from mnemospark.session import materialised

#: Entries times this become whole numbers.
SCALE = 64

#: Entries of this size or more are treated as not finite; smaller ones are exact.
LARGEST = float(1 << 46)

#: States that one task of the combining tree folds.
FAN_IN = 8

EPS = np.finfo(float).eps


def _roots(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Roots of 1 + sum w_j / (d_j - x) for rising d and positive w, as differences d_j - x_i.

    Root i lies between d_i and the next pole. It is sought as a distance from the nearer
    of the two, by the rational function with both poles that has the same value and
    slopes, kept inside a bracket that shrinks with every step.
    """
    k = len(d)
    gap = np.append(np.diff(d), w.sum())
    own = np.arange(k)
    middle = d + gap / 2
    right = (1 + (w / (d - middle[:, None])).sum(axis=1) < 0) & (own < k - 1)
    near = d[np.minimum(own + right, k - 1)]
    delta = d - near[:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(own < k - 1, gap / 2, gap))
    x = (low + high) / 2
    below = own[None, :] <= own[:, None]
    done = np.zeros(k, bool)
    with np.errstate(all="ignore"):
        for _ in range(60):
            away = delta - x[:, None]
            part = w / away
            slope = part / away
            f = 1 + part.sum(axis=1)
            done |= np.abs(f) <= 4 * EPS * (1 + np.abs(part).sum(axis=1))
            if done.all():
                break
            low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
            psi = (slope * below).sum(axis=1)
            phi = slope.sum(axis=1) - psi
            a1, a2 = away[own, own], np.append(away[own[:-1], own[1:]], 0.0)
            c = f - a1 * psi - a2 * phi
            a = (a1 + a2) * f - a1 * a2 * (psi + phi)
            b = a1 * a2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = a1[-1] + a1[-1] ** 2 * psi[-1] / (f[-1] - a1[-1] * psi[-1])
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            x = np.where(done, x, new)
    return delta - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``vectors diag(values) vectors' + rho v v'`` for rising values and rho > 0."""
    z = vectors.T @ v * np.sqrt(rho)
    size = float(z @ z)
    if size == 0.0:
        return values, vectors
    tiny = 8 * EPS * max(abs(values[0]), abs(values[-1]), size)
    close = np.diff(values) <= tiny
    if close.any():
        # Equal eigenvalues: turn their vectors so that one alone carries the weight.
        vectors, z = vectors.copy(), z.copy()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
        for start, stop in zip(edges[::2], edges[1::2] + 1):
            part = z[start:stop]
            left = -np.copysign(np.linalg.norm(part), part[-1])
            mirror = part.copy()
            mirror[-1] -= left
            square = mirror @ mirror
            if square > 0:
                block = vectors[:, start:stop]
                vectors[:, start:stop] = block - np.outer(block @ mirror, mirror * (2 / square))
                z[start:stop] = 0.0
                z[stop - 1] = left
    active = np.flatnonzero(np.abs(z) * np.sqrt(size) > tiny)
    if not len(active):
        return values, vectors
    d, w = values[active], z[active] ** 2
    away = _roots(d, w)
    k = len(d)
    # The weights that have exactly these roots: vectors made of them are orthogonal.
    poles = d[:, None] - d[None, :]
    shifted = np.vstack([poles[1:], np.ones(k)])
    below = np.arange(k)[:, None] < np.arange(k)[None, :]
    ratio = -away / np.where(below, poles, shifted)
    weight = np.copysign(np.sqrt(np.abs(ratio.prod(axis=0))), z[active])
    turned = weight / away
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[active] = d - away[np.arange(k), np.arange(k)]
    new_vectors[:, active] = vectors[:, active] @ turned.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Eigenpairs of the scatter of ``n`` vectors around their mean, and their exact sums."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, [0] * dimension, np.zeros(dimension), np.zeros(dimension), np.eye(dimension))

    def add(self, rows: np.ndarray) -> None:
        """Take in rows of whole numbers, one after the other."""
        self.sums = [a + b for a, b in zip(self.sums, rows.sum(axis=0).tolist())]
        for row in rows.astype(float):
            apart = row - self.mean
            self.n += 1
            self.mean = self.mean + apart / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, (self.n - 1) / self.n)

    def merged(self, other: Spectrum) -> Spectrum:
        """Both together; the eigenpairs of the smaller are added to the larger."""
        big, small = (self, other) if self.n >= other.n else (other, self)
        values, vectors = big.values, big.vectors
        for value, vector in zip(small.values, small.vectors.T):
            if value > 0:
                values, vectors = rank_one(values, vectors, vector, value)
        n = big.n + small.n
        apart = small.mean - big.mean
        if small.n:
            values, vectors = rank_one(values, vectors, apart, big.n * small.n / n)
        mean = big.mean + apart * (small.n / max(n, 1))
        return Spectrum(n, [a + b for a, b in zip(big.sums, small.sums)], mean, values, vectors)


@dataclass
class Whitening:
    """``components`` are columns by falling ``eigenvalues``; x is centred by ``whole`` + ``rest`` / n."""

    n: int
    whole: np.ndarray
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.whole)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array([r / self.n for r in self.rest])

    def scales(self) -> np.ndarray:
        """What projections are multiplied with; nan without variance."""
        least = 16 * self.dimension * EPS * max(self.eigenvalues.max(initial=0.0), 0.0)
        return np.where(self.eigenvalues > least, 1 / np.sqrt(np.maximum(self.eigenvalues, least + 1e-300)), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components * self.scales()

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        apart = x - self.whole
        largest = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if self.dimension * largest**2 < 1 << 63:
            away = self.n * apart - np.array(self.rest, np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = (sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in apart.tolist())
        return [e if e < 1 << 63 else None for e in exact]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding (doubles) of the rows that count, and their dimension (0 without any)."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < LARGEST))
    found = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    most = found.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimension = most["size"] if most else 0
    return found.where(F.size("embedding") == dimension), dimension


def _whole_numbers(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(-1, dimension)).astype(np.int64)


def _summed(rows: DataFrame, dimension: int, start: Callable, add: Callable, merge: Callable):
    """One state for all rows: one per task, folded in a tree; None without rows."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for batch in batches:
            if batch.num_rows:
                state, some = add(state, _whole_numbers(batch, dimension)), True
        if some:
            yield _row(TaskContext.get().partitionId(), state)

    def fold(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("part")
        states = [pickle.loads(s.as_py()) for s in ordered.column("state")]
        whole = states[0]
        for state in states[1:]:
            whole = merge(whole, state)
        return pa.Table.from_batches([_row(ordered.column("part")[0].as_py() // FAN_IN, whole)])

    schema = "part long, state binary"
    states = materialised(rows.select("embedding").mapInArrow(per_task, schema))
    left = states.agg(F.max("part")).first()[0]
    while left:
        grouped = states.groupBy(F.expr(f"part div {FAN_IN}L").alias("bucket"))
        states = materialised(grouped.applyInArrow(fold, schema))
        left //= FAN_IN
    found = states.first()
    return pickle.loads(bytes(found["state"])) if found else None


def _row(part: int, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": pa.array([part], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())}
    )


def fit(rows: DataFrame, dimension: int, components: int = 32) -> Whitening | None:
    """The whitening of all ``rows`` (see :func:`usable`) by their first components."""

    def add(spectrum: Spectrum, x: np.ndarray) -> Spectrum:
        spectrum.add(x)
        return spectrum

    if not dimension:
        return None
    spectrum = _summed(rows, dimension, lambda: Spectrum.empty(dimension), add, Spectrum.merged)
    if spectrum is None:
        return None
    n = spectrum.n
    split = [divmod(s, n) for s in spectrum.sums]
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    rough = Whitening(n, np.array([q for q, _ in split], np.int64), [r for _, r in split], basis, np.ones(dimension), np.ones(dimension))

    def project(total: np.ndarray, x: np.ndarray) -> np.ndarray:
        seen = rough.centred(x) @ basis
        return total + seen.T @ seen

    covariance = _summed(rows, dimension, lambda: np.zeros((dimension, dimension)), project, np.add) / n
    values, turned = np.linalg.eigh(covariance)
    values, turned = np.maximum(values[::-1], 0.0), turned[:, ::-1]
    trace = float(np.trace(covariance))
    explained = values / trace if trace > 0 else np.full(dimension, np.nan)
    kept = slice(0, components)
    model = Whitening(n, rough.whole, rough.rest, (basis @ turned)[:, kept], values[kept], explained[kept])
    model.identity_error = identity_error(rows, model)
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, measured on all rows."""
    some = np.flatnonzero(~np.isnan(model.scales()))
    if not len(some):
        return None

    def square(total: tuple, x: np.ndarray) -> tuple:
        seen = model.whitened(x)[:, some]
        return total[0] + seen.sum(axis=0), total[1] + seen.T @ seen

    def both(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    sums, squares = _summed(rows, model.dimension, lambda: (0.0, 0.0), square, both)
    mean = sums / model.n
    return float(np.abs(squares / model.n - np.outer(mean, mean) - np.eye(len(some))).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, whitened (array, null where a component has no variance) and deviation of each row."""

    def run(batch: pa.RecordBatch) -> dict:
        x = _whole_numbers(batch, model.dimension)
        seen = model.whitened(x)
        flat = pa.array(seen.ravel(), pa.float64(), mask=np.isnan(seen).ravel())
        offsets = pa.array(np.arange(len(x) + 1) * seen.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, flat)
        return {"vec_id": batch.column("vec_id"), "whitened": lists, "deviation": model.deviations(x)}

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return map_batches(rows, run, f"vec_id {id_type}, whitened array<double>, deviation long")
