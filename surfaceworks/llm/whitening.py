"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

Nothing ever holds the covariance: each step multiplies it with a block of vectors in one pass over
the distinct vectors, X'(Xv) with rows centred before they are multiplied, and what comes to the driver
is one matrix of dimensions x block, summed in two steps on the way. Every new block is made orthogonal to all before it, twice;
directions that vanish are replaced by random ones (a restart), until the residuals of the wanted
eigenpairs, computed from the products that were made, are below ``TOLERANCE`` of the largest eigenvalue
or the basis spans the whole space. The trace for the explained shares comes from the exact sums
of squared deviations, not from the eigenvalues.

Rows are stashed once as bytes of 64-bit integers, dealt by their own hash, so any number of equal vectors
is reduced to one before it is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Stash, bound_batches, give_back

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, BLOCK = 16, 8
#: Residual of an eigenpair, and eigenvalue below which a direction has no variance; of the largest eigenvalue.
TOLERANCE, NOTHING = 1e-13, 1e-12
#: Partial sums of a pass are added up in so many groups before they come to the driver.
GROUPS = 64


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): 64-bit integers floor(64 c) + 1000000 as little-endian bytes; rows with missing or odd entries go."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**56)))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(fine)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = (np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT).astype("<i8").tobytes()
            ends = 8 * np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))))
            blobs = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _total(fit: DataFrame, size: int, part, names: tuple[str, ...] = ("x",)) -> np.ndarray:
    """The sum over all batches of ``part(batch)``, an array of ``size`` doubles: by task, in groups, then here."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["g", "s"])

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = fit.select(*names).mapInArrow(run, "g long, s binary")
    if fit.rdd.getNumPartitions() > GROUPS:
        parts = parts.repartition(GROUPS, "g")
        parts = parts.select("s").mapInArrow(add, "s binary")
    else:
        parts = parts.select("s")
    return np.sum([np.frombuffer(r.s) for r in parts.collect()] or [np.zeros(size)], axis=0)


class Whitener:
    """Components of a fit list: n, exact sums for each dimension, unit eigenvectors, eigenvalues, trace, how it went."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float, passes: int, restarts: int, error: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace
        self.passes, self.restarts, self.identity_error = passes, restarts, error


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole part and rest of the mean: subtracting them one after the other loses nothing to cancellation."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole, strict=True)])
    return whole, rest


def lanczos(multiply, d: int, wanted: int, block: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(eigenvalues falling, unit eigenvectors as columns, passes, restarts) of a symmetric d x d operator.

    ``multiply(Q)`` is the operator times a d x b block. Full reorthogonalisation; a block that loses rank gets
    random directions orthogonal to the basis; ends when the residuals of all wanted pairs are small or the basis is whole.
    """
    random = np.random.default_rng(seed)
    basis, products = np.zeros((d, 0)), np.zeros((d, 0))
    restarts = passes = 0

    def orthonormal(candidates: np.ndarray, room: int) -> np.ndarray:
        """At most ``room`` unit columns orthogonal to the basis and each other; random ones for those that vanish."""
        nonlocal restarts
        out = basis
        for c in candidates.T[:room]:
            norm = np.linalg.norm(c)
            for attempt in range(10):
                restarts += not norm
                v = c / norm if norm else random.normal(size=d)
                for _ in range(2):
                    v = v - out @ (out.T @ v)
                left = np.linalg.norm(v)
                if left > (1e-10 if attempt == 0 else 1e-3):
                    v = v / left
                    v = v - out @ (out.T @ v)
                    out = np.column_stack([out, v / np.linalg.norm(v)])
                    break
                norm = 0.0
        return out[:, basis.shape[1] :]

    ahead = random.normal(size=(d, min(block, d)))
    while True:
        new = orthonormal(ahead, d - basis.shape[1])
        got = multiply(new)
        passes += 1
        basis, products = np.column_stack([basis, new]), np.column_stack([products, got])
        small = basis.T @ products
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz = basis @ y
        residuals = np.linalg.norm(products @ y - ritz * values, axis=0)
        m = min(wanted, d)
        if basis.shape[1] == d or (basis.shape[1] >= m + block and (residuals[:m] <= TOLERANCE * max(abs(values[0]), 1e-300)).all()):
            return values[:m], ritz[:, :m] / np.linalg.norm(ritz[:, :m], axis=0), passes, restarts
        ahead = got - basis @ (basis.T @ got)
        scale = np.linalg.norm(got, axis=0)
        ahead[:, np.linalg.norm(ahead, axis=0) <= 1e-12 * np.maximum(scale, 1e-300)] = 0.0


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitener | None:
    """Whitens the distinct vectors (x binary) of d 64-bit integers; None if there are none. Runs a job for each pass.

    Directions without variance aren't components, so vectors of rank r give r of them at most; a single
    distinct vector gives none. The driver holds matrices of d x d doubles at most.
    """

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
            total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low, high, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "sums"])

    parts = distinct.select("x").mapInArrow(run, "n long, sums array<string>")
    exact = parts.select("n", F.posexplode(F.transform("sums", lambda s: s.cast("decimal(38,0)")))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect()
    if not exact or not exact[0].n:
        return None
    n, sums = exact[0].n, [int(r.s) for r in exact]
    whole, rest = _centre(n, sums)

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(batch):
            x = (_matrix(batch.column(0), d) - whole).astype(np.float64) - rest
            return (x.T @ (x @ q)).ravel()

        return _total(distinct, q.size, part).reshape(q.shape) / n

    squares = _total(distinct, 1, lambda batch: np.array([np.square((_matrix(batch.column(0), d) - whole).astype(np.float64) - rest).sum()]))
    trace = float(squares[0]) / n
    values, vectors, passes, restarts = lanczos(multiply, d, components, block)
    keep = values > NOTHING * max(values[0], 1e-300) if trace > 0 else np.zeros(len(values), bool)
    values, vectors = values[keep], vectors[:, keep]
    k = len(values)
    if k:
        scaled = vectors / np.sqrt(values)

        def part(batch):
            w = ((_matrix(batch.column(0), d) - whole).astype(np.float64) - rest) @ scaled
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        got = _total(distinct, k + k * k, part) / n
        error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    else:
        error = 0.0
    return Whitener(n, sums, vectors, values, trace, passes, restarts, error)


def apply(rows: DataFrame, model: Whitener) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, x), a row for each component."""
    n, sums, k, d = model.n, model.sums, len(model.values), len(model.sums)
    whole, rest = _centre(n, sums)
    scaled = model.vectors / np.sqrt(model.values) if k else np.zeros((d, 0))
    left = np.array([s - n * int(w) for s, w in zip(sums, whole, strict=True)], np.int64)
    explained, error = model.values / model.trace if k else model.values, model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null where it doesn't fit."""
        off = x - whole
        most = (np.abs(off).max(initial=0) + 1.0) * n
        if most * most * d < 2.0**62:
            return np.square(n * off - left).sum(1).tolist()
        exact = [sum((n * int(o) - int(r)) ** 2 for o, r in zip(row, left, strict=True)) for row in off]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            w = ((x - whole).astype(np.float64) - rest) @ scaled
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)), pa.array([v for v in deviations(x) for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        give_back()

    return rows.select("vec_id", "x").mapInArrow(run, _OUT)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors along the first components of the distinct ones. Runs jobs.

    A vector that is null or empty, or holds null, non-finite or huge (2^56 and more) entries gives no rows; other
    columns are not looked at. Repeated vectors count once for the fit and each give their rows; ids may be null or repeat.
    The dimension is the one that most vectors have, the larger of equals; vectors of another are left out.
    Equal eigenvalues leave the choice of their components open, and their signs are open always. Fewer components than
    asked are given where the distinct vectors vary in fewer directions; no variance or an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    stash = Stash(spark, "whitening")
    rows = stash.put(_usable(vectors, id_col, vector_col))
    lengths = rows.groupBy(F.octet_length("x").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("bytes")).first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    rows = rows.where(F.octet_length("x") == lengths.bytes)
    distinct = stash.put(rows.select("x").distinct())
    model = fit(distinct, lengths.bytes // 8, components)
    return apply(rows, model)
