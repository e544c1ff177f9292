"""Whitening of embeddings: leading eigenvectors by Chebyshev-filtered subspace iteration.

The covariance of the vectors is never built. One pass over the stored rows
multiplies a narrow block: each task computes X'(XQ) of its centred rows, and
the tasks' matrices are added row by row on the executors. The driver keeps
only matrices of dimension x block.

A block of ``components + extra`` columns is filtered by a Chebyshev polynomial
of the covariance (the three-term recurrence, one pass a degree) that is small
on the unwanted part of the spectrum and grows fast above it; then QR and
Rayleigh-Ritz. This is repeated until the residuals certify every wanted pair.
The polynomial's interval reaches from a bound below the spectrum, found by a
Lanczos vector that rides along in the first filter, to the smallest value of
the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import pick
from panelkit.session import cut_lineage

BLOCK_ROWS = 4_096
EXTRA = 16  # columns of the block beside the wanted ones
DEGREE = 10  # first filter; a later one takes the degree that its gap asks for
MOST_DEGREE = 40
CYCLES = 100
CERTIFIED = 1e-12  # residual over the largest eigenvalue
LARGEST = 1 << 52  # entries beyond it are set to it


def to_blocks(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """Stored blocks (ids, dims, x) of the rows with a whole, finite, non-empty vector; x = floor(scale * c) + shift as 64-bit integers."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col)
    whole = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall(
        F.col("vector"), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.where(whole).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK_ROWS):
                b = whole_batch.slice(at, BLOCK_ROWS)
                lists = b.column("vector")
                sizes = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy(zero_copy_only=False)
                x = np.clip(np.floor(scale * values) + shift, -LARGEST, LARGEST).astype("<i8")
                ends = np.cumsum(sizes)
                for d in np.unique(sizes).tolist():
                    these = np.flatnonzero(sizes == d)
                    flat = x[(ends[these] - d)[:, None] + np.arange(d)]
                    ids = b.column("vec_id").take(pa.array(these))
                    lists_of_ids = pa.ListArray.from_arrays(pa.array([0, len(these)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays(
                        [lists_of_ids, pa.array([d], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["ids", "dims", "x"])

    return cut_lineage(rows.mapInArrow(blocks, f"ids array<{id_type}>, dims long, x binary"))


def matrix(raw, dims: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dims)


def added(rows: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums of equally long binary vectors by row number ``i``; the tasks' parts are added in a fixed order on the executors."""
    def add(key, parts):
        parts = parts.sort_by("part")
        v = np.sum([np.frombuffer(p.as_buffer(), kind) for p in parts.column("v").combine_chunks()], axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([v.astype(kind).tobytes()], pa.binary())})

    got = rows.groupBy("i").applyInArrow(add, "i long, v binary").collect()
    return {r["i"]: np.frombuffer(r["v"], kind) for r in got}


class Covariance:
    """The covariance of stored integer rows as an operator on narrow blocks."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks.where(F.col("dims") == dims).select("x"), dims
        self.passes = 0

        def sums(batches):
            s, n = np.zeros(dims, "<i8"), 0
            for b in batches:
                for raw in b.column("x"):
                    x = matrix(raw, dims)
                    s += x.sum(0)
                    n += len(x)
            yield from part_rows({0: s, 1: np.array([n], "<i8")})

        got = added(self.blocks.mapInArrow(sums, "i long, part long, v binary"), "<i8")
        self.sums, self.n = got[0], int(got[1][0])
        self.trace = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q in one pass; the first pass also adds up the trace of V."""
        dims, n, sums, first = self.dims, self.n, self.sums, self.trace is None

        def product(batches):
            y, t = np.zeros(q.shape), 0.0
            for b in batches:
                for raw in b.column("x"):
                    c = (n * matrix(raw, dims) - sums) / n
                    y += c.T @ (c @ q)
                    if first:
                        t += float((c * c).sum())
            yield from part_rows(dict(enumerate(y / n)) | ({-1: np.array([t / n])} if first else {}))

        got = added(self.blocks.mapInArrow(product, "i long, part long, v binary"), "<f8")
        self.passes += 1
        if first:
            self.trace = float(got[-1][0])
        return np.array([got[i] for i in range(dims)])


def part_rows(vectors: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(vectors), pa.int64()), pa.array([part] * len(vectors), pa.int64()),
         pa.array([v.tobytes() for v in vectors.values()], pa.binary())], ["i", "part", "v"])


def chebyshev(times, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled polynomial of the operator that is small on [low, high] and 1 at ``top``; one pass a degree."""
    half, centre = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (times(q) - centre * q) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


class Rider:
    """A Lanczos vector multiplied beside the block, for a bound below the spectrum."""

    def __init__(self, dims: int, rng):
        v = rng.standard_normal(dims)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    def take(self, image: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ image))
        for b in self.basis:  # whole orthogonalisation, twice
            image = image - (b @ image) * b
        for b in self.basis:
            image = image - (b @ image) * b
        self.beta.append(float(np.linalg.norm(image)))
        self.basis.append(image / self.beta[-1] if self.beta[-1] > 0 else np.zeros_like(v))

    def bound(self) -> float:
        """Smallest Ritz value less its residual, and not below 0."""
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        e, u = np.linalg.eigh(t)
        return max(0.0, float(e[0] - self.beta[-1] * abs(u[-1, 0])))


def leading(cov: Covariance, components: int, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance, certified by their residuals."""
    dims = cov.dims
    rng = np.random.default_rng(13)
    size = min(dims, components + extra)
    q = np.linalg.qr(rng.standard_normal((dims, size)))[0]
    rider, low, degree, best = None if size == dims else Rider(dims, rng), 0.0, DEGREE, np.inf
    for _ in range(CYCLES):
        image = cov.times(q)
        e, u = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        order = np.argsort(-e, kind="stable")
        e, u = e[order], u[:, order]
        q, image = q @ u, image @ u
        wanted = slice(0, min(components, size))
        error = float(np.linalg.norm(image[:, wanted] - q[:, wanted] * e[wanted], axis=0).max(initial=0))
        if error <= CERTIFIED * max(e[0], 0) or size == dims:
            # a further cycle would gain at most the rounding of the sums
            return e[wanted], q[:, wanted]
        high = float(e[-1])
        if rider is not None and rider.alpha:
            low, rider = min(rider.bound(), 0.999 * high), None
        if low > 0:  # degree that brings the residual to the certificate at the wanted end of the spectrum
            t = (2 * e[wanted][-1] - high - low) / max(high - low, 1e-300)
            gain = np.arccosh(max(t, 1 + 1e-9))
            degree = int(np.clip(np.ceil(np.log(2 * error / (CERTIFIED * 0.01 * e[0])) / gain), 4, MOST_DEGREE))

        def times(y):
            if rider is None:
                return cov.times(y)
            both = cov.times(np.column_stack([y, rider.basis[-1]]))
            rider.take(both[:, -1])
            return both[:, :-1]

        if high <= low:
            q = np.linalg.qr(image)[0]
        else:
            q = np.linalg.qr(chebyshev(times, q, degree, low, high, float(e[0])))[0]
    raise RuntimeError(f"{components} components not certified after {CYCLES} cycles: residual {error:.3g} of {e[0]:.3g}")


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every whole row and component.

    Rows with a null vector, or with null, NaN or infinite entries, have no
    result, nor have empty vectors and vectors of another length than the most
    frequent one (ties: the longer). Null and repeated ids and repeated vectors
    are kept, one set of result rows per input row. A component without
    variance (at most 1e-12 of the largest) has no rows, so a single row, a
    constant table and an empty table give an empty result. Entries beyond 2^52 after
    scaling are set to it; ``deviation`` is null where it exceeds 63 bits. Only the two
    named columns are read, so other columns cannot clash.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    blocks = to_blocks(vectors, scale, shift, id_col, vector_col)
    usual = blocks.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    cov = Covariance(blocks, usual["dims"])
    e, q = leading(cov, components)
    alive = e > 1e-12 * max(cov.trace, 0)
    e, q = e[alive], q[:, alive]
    if not len(e):
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n, sums, scaled, share = cov.dims, cov.n, cov.sums, q / np.sqrt(e), e / cov.trace

    def products(batches):
        y = np.zeros((len(e), len(e)))
        for b in batches:
            for raw in b.column("x"):
                w = ((n * matrix(raw, dims) - sums) / n) @ scaled
                y += w.T @ w
        yield from part_rows(dict(enumerate(y / n)))

    got = added(cov.blocks.mapInArrow(products, "i long, part long, v binary"), "<f8")
    error = float(np.abs(np.array([got[i] for i in range(len(e))]) - np.eye(len(e))).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for b in batches:
            for ids, raw in zip(b.column("ids"), b.column("x")):
                x = matrix(raw, dims)
                w = ((n * x - sums) / n) @ scaled
                at = n * x - sums
                if float(np.abs(at).max(initial=0)) ** 2 * dims < 2.0 ** 62:
                    d = (at ** 2).sum(1).tolist()
                else:  # beyond 64-bit integers somewhere
                    d = [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in r) for r in at)]
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array([v for v in d for _ in range(k)], pa.int64()), pa.array(w.ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.where(F.col("dims") == dims).select("ids", "x").mapInArrow(rows, schema)
