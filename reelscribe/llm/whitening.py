"""Operator 13, embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

1. Vectors become integers, and each distinct one is listed once (an aggregate on their bytes, so a hot vector is summed in the
   tasks). The list is staged in blocks; its count and sums are exact.
2. X is the list, centred row by row and divided by the root of its count. Each step is one pass of alternating products, p = X q and z = X' p, in
   blocks; a task returns one vector of partial sums, and these are added up by a tree of bounded width.
3. Left vectors have a number for each row and are never stored: u_j = X w_j with a small w_j, so X'u_j and the products u_i.u_j
   follow from the z of each step. Both sides are fully reorthogonalised: left ones by their w, right ones twice against all before.
   A side that is used up starts again from a fresh direction.
4. The SVD of the small bidiagonal matrix gives components and deviations. Steps end when the leading ones are settled to rounding and the
   variance that is not in the basis is less than theirs (so none can be missing), or when the basis is whole.

Edge cases: rows whose vector is null or holds a null, NaN or infinity go, as do components of 2^32 or more in size. A vector shorter than the longest one has
zeros beyond its end. Null ids and repeated rows are rows like any other. Directions without variance are not components: equal
vectors, a single one, or an empty table give no rows. With equal eigenvalues any basis of their directions may come. A deviation beyond a long is null.
Only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.vectors import decode, encode, integer_vectors
from reelscribe.session import stage_table

COMPONENTS = 4
LIMIT = 1 << 40
#: Bytes of a block and of what one task of a pass reads; partial sums that meet in one place.
BLOCK_BYTES, TASK_BYTES, FAN = 1 << 20, 1 << 24, 64
EPS = float(np.finfo(np.float64).eps)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Blocks (n, width, data) of each distinct vector once, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            step = max(1, BLOCK_BYTES // max(map(len, rows), default=1))
            for at in range(0, len(rows), step):
                x = decode(rows[at : at + step])
                data = encode(x.reshape(-1), np.array([x.size]))
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[0]]), pa.array([x.shape[1]]), pa.array(data, pa.binary())], ["n", "width", "data"])

    return stage_table(vectors.select("x").distinct().mapInArrow(run, "n long, width long, data binary"))


def total(blocks: DataFrame, tasks: int, width: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``part`` (a vector of ``size`` numbers) of the block's matrix, ``width`` wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = decode([data]).reshape(n, -1)
                got += part(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
        yield pa.RecordBatch.from_arrays([pa.array([got.tolist()])], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                got += v
        yield pa.RecordBatch.from_arrays([pa.array([got.tolist()])], ["v"])

    sums = blocks.select("n", "data").coalesce(tasks).mapInArrow(run, "v array<double>")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        sums = sums.repartition(tasks).mapInArrow(add, "v array<double>")
    return np.sum([r.v for r in sums.collect()], axis=0) if size else np.zeros(0)


def exact_sums(blocks: DataFrame, width: int) -> np.ndarray:
    """Sums of every dimension, in longs: one row for each block and dimension, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(width, np.int64)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = decode([data]).reshape(n, -1)
                got[: x.shape[1]] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(got)], ["k", "s"])

    sums = np.zeros(width, np.int64)
    for r in blocks.select("n", "data").mapInArrow(run, "k long, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():
        sums[r.k] = r.s
    return sums


@dataclass
class Bidiagonal:
    """Right basis ``v`` (columns), ``w`` with u_j = X w_j, ``y`` = X'u_j, and the entries of the bidiagonal matrix."""

    v: np.ndarray
    w: np.ndarray
    y: np.ndarray
    alpha: list[float]
    beta: list[float]

    def svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.alpha)
        b = np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1)
        return np.linalg.svd(b)


def fresh(basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A unit vector that is orthogonal to the basis."""
    r = rng.standard_normal(basis.shape[0])
    for _ in range(3):
        r -= basis @ (basis.T @ r)
        r /= np.linalg.norm(r)
    return r


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], width: int, trace: float, wanted: int, seed: int = 1) -> Bidiagonal:
    """``product`` of q gives ||Xq||^2 and X'Xq."""
    rng = np.random.default_rng(seed)
    empty = np.zeros((width, 0))
    found = Bidiagonal(empty, empty, empty, [], [])
    v, beta, before = fresh(empty, rng), 0.0, np.zeros(width)
    scale = np.sqrt(trace)
    while True:
        q = v - beta * before
        for last in (False, False, True):
            square, z = product(q)
            h = found.w.T @ z  # u_j.p of all earlier j
            q = q - found.w @ h
            if last or np.linalg.norm(h) <= 1e-7 * np.sqrt(square):  # within rounding: correct the products themselves
                square, z = max(0.0, square - h @ h), z - found.y @ h
                break
        alpha = float(np.sqrt(square))
        zero = alpha <= 64 * EPS * scale
        if zero:
            alpha, before, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            before, z = q / alpha, z / alpha
        found = Bidiagonal(np.column_stack([found.v, v]), np.column_stack([found.w, before]), np.column_stack([found.y, z]), [*found.alpha, alpha], found.beta)
        r = z - alpha * v
        for _ in range(2):
            r -= found.v @ (found.v.T @ r)
        beta = float(np.linalg.norm(r))
        if beta <= 64 * EPS * scale:
            beta = 0.0
        found.beta.append(beta)
        k = len(found.alpha)
        if k == width:
            return found
        left, sigma, _ = found.svd()
        lead = min(wanted, k)
        settled = lead == wanted and beta * np.abs(left[-1, :lead]).max() <= 4 * EPS * sigma[0]
        if settled and trace - float(sigma @ sigma) < sigma[lead - 1] ** 2 * (1 - 1e-9) or trace - float(sigma @ sigma) <= 64 * EPS * trace and beta == 0.0:
            return found
        v = r / beta if beta else fresh(found.v, rng)


@dataclass
class Whitening:
    """What whitens a vector x: (x - sums / n) @ components / deviations. Components are columns, by falling variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / max(1, self.n)) @ self.components / np.sqrt(self.variances)


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Whitening:
    """Leading components of the distinct vectors (``x`` as bytes)."""
    blocks = fit_list(vectors)
    known = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("width"), F.lit(0)).alias("width"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes")).first()
    n, width, tasks = known.n, known.width, 1 + known.bytes // TASK_BYTES
    none = Whitening(n, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
    if n < 2 or width == 0:
        return none
    sums = exact_sums(blocks, width)
    mean = sums / n
    trace = float(total(blocks, tasks, width, 1, lambda x: np.array([np.square(x - mean).sum()]))[0]) / n
    if trace == 0.0:
        return none

    def product(q: np.ndarray) -> tuple[float, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            p = centred @ q
            return np.append(centred.T @ p, p @ p)

        got = total(blocks, tasks, width, width + 1, part) / n
        return float(got[-1]), got[:-1]

    found = bidiagonalise(product, width, trace, wanted)
    _, sigma, right = found.svd()
    lead = int((sigma[:wanted] > 1e-12 * sigma[0]).sum())
    components = found.v @ right[:lead].T
    components /= np.linalg.norm(components, axis=0)
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(lead)])
    fitted = Whitening(n, sums, components * signs, np.square(sigma[:lead]), trace, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        white = fitted.apply(x)
        return np.append((white.T @ white).reshape(-1), white.sum(axis=0))

    got = total(blocks, tasks, width, lead * (lead + 1), moments) / n
    covariance = got[: lead * lead].reshape(lead, lead) - np.outer(got[lead * lead :], got[lead * lead :])
    fitted.identity_error = float(np.abs(covariance - np.eye(lead)).max())
    return fitted


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2 of every row, exact; null beyond a long."""
    most = n * (int(np.abs(x).max()) if x.size else 0) + int(np.abs(sums).max())
    if most * most * x.shape[1] < 1 << 63:
        return np.square(n * x - sums).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, wanted: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each row and component: the id, component, n, deviation, whitened, explained and identity_error."""
    vectors = integer_vectors(rows, [rows[id_column].alias("vec_id")], column, LIMIT)
    fitted = fit(vectors, wanted)
    n, sums, lead = fitted.n, fitted.sums, len(fitted.variances)
    explained = fitted.variances / fitted.trace if lead else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if lead else ():
            x = decode(batch.column(1).to_pylist(), len(sums))
            rows, number = np.repeat(np.arange(len(x)), lead), np.tile(np.arange(lead), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(rows), n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows)),
                    pa.array(fitted.apply(x).reshape(-1)), pa.array(explained[number]), pa.array(np.full(len(rows), fitted.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
