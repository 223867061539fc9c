"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance is never formed. A pass multiplies it with a block of vectors: each task centres its rows, projects them on the
block and adds up what comes back, so that only numbers of the block's size are shuffled and reach the driver. The Krylov
basis is made orthogonal to all of itself, twice, in each step; a column that vanishes (an invariant subspace is full) restarts with a random one; a basis
that has grown to ``most`` columns restarts with its best Ritz vectors. The steps end when the residuals of all wanted
eigenpairs, measured on the products themselves, are below ``TOLERANCE`` of the largest eigenvalue, or the basis is the whole space.

Numbers: entry c, as double, is x = floor(64 * c) + 1000000; the fit list holds each different vector once. Rows are centred
exactly, as n * x - S in integers, before anything is multiplied; the trace is the sum of these squares.

Defined cases: rows whose vector is null, or holds null or non-finite entries, or entries of ``FAR`` and more (whose integers no
long could sum), are left out, as are empty vectors and those whose length is not the most common of the fit list (of equally
common ones, the longest); directions in which the list does not vary (less than ``LEAST_SHARE`` of the largest eigenvalue) cannot be whitened and are
no components, so that a table of one vector gives no rows; a deviation beyond a long is null; repeated rows, equal ids and
null ids give their rows each; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.shared import staged

COMPONENTS, BLOCK, MOST = 16, 16, 256
TOLERANCE, PASSES, LEAST_SHARE = 1e-13, 200, 1e-10
SCALE, SHIFT, FAR = 64, 1_000_000, float(1 << 30)
ROWS = 4096  # rows that a task turns into numbers at once
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- the method, on any symmetric operator ---


def orthonormal(w: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Columns that span those of ``w`` beside ``basis``; how many vanished and were drawn at random. No more than the space has room for."""
    d, out, drawn = len(w), basis, 0
    for column in w.T:
        if out.shape[1] == d:
            break
        v, least = column, 1e-13 * scale
        for attempt in range(10):
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                v = v / size
                out = np.c_[out, v - out @ (out.T @ v)]
                out[:, -1] /= np.linalg.norm(out[:, -1])
                break
            drawn += attempt == 0
            v, least = rng.standard_normal(d), 1e-8
    return out[:, basis.shape[1] :], drawn


@dataclass
class Eigenpairs:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int
    restarts: int


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, most: int = MOST, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 7) -> Eigenpairs:
    """The ``k`` largest eigenpairs of a symmetric positive operator that is known by its products with blocks of vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, d)
    block, most = min(block, d), max(most, k + 2 * block)
    now, _ = orthonormal(rng.standard_normal((d, block)), np.zeros((d, 0)), 1.0, rng)
    basis, image, restarts, done = np.zeros((d, 0)), np.zeros((d, 0)), 0, 0
    while True:
        basis, image, done = np.c_[basis, now], np.c_[image, product(now)], done + 1
        ritz = basis.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        scale = max(float(values[0]), 0.0)
        residuals = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if basis.shape[1] == d or (basis.shape[1] >= k and (residuals <= tolerance * scale).all()) or done >= passes:
            return Eigenpairs(values[:k], vectors[:, :k], residuals, done, restarts)
        if basis.shape[1] + block > most:  # the best vectors so far, and what is left of them, go on
            keep = k + block
            basis, image = vectors[:, :keep], images[:, :keep]
            now, drawn = orthonormal((images - vectors * values)[:, :block], basis, scale, rng)
            restarts += 1 + drawn
            continue
        last = image[:, -now.shape[1] :]  # the three-term step and the full one are the same here: all of the basis is taken off
        now, drawn = orthonormal(last, basis, scale, rng)
        restarts += drawn


# --- on a table ---


def integers(column: Column) -> Column:
    """array<long> of x, null where an entry is null, not finite or too large."""
    values = column.cast("array<double>")
    fair = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FAR))
    return F.when(values.isNotNull() & F.coalesce(fair, F.lit(False)) & (F.size(values) > 0), F.transform(values, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _blocks(batches: Iterator[pa.RecordBatch], name: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time, and their vectors as a matrix of integers."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            some = b.slice(at, ROWS)
            yield some, some.column(some.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, kinds: list[str], work: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """``work`` turns a task's rows into a matrix (a line for each number at its first place); the tasks' matrices are added."""
    width = len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(batches)
        columns = [pa.array(np.arange(len(found), dtype=np.int32)), *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["i", *(f"v{j}" for j in range(width))])

    each = rows.mapInArrow(run, ", ".join(["i int", *(f"v{j} {kind}" for j, kind in enumerate(kinds))]))
    total = each.groupBy("i").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(width))).orderBy("i").toArrow()
    return np.stack([total.column(j + 1).to_numpy() for j in range(width)], axis=1)


class Whitening:
    """Fitted on the different vectors of ``vectors`` (columns vec_id and ``column``)."""

    def __init__(self, vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, most: int = MOST, tolerance: float = TOLERANCE, seed: int = 7):
        self.rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(column)).alias("x")).filter("x IS NOT NULL")
        every = staged(self.rows.select("x").distinct())
        lengths = every.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.n, self.d = (int(lengths["n"]), int(lengths["d"])) if lengths else (0, 0)
        self.values, self.vectors, self.trace, self.identity_error, self.pairs = np.zeros(0), np.zeros((self.d, 0)), 0.0, 0.0, None
        if not self.n:
            return
        d, n = self.d, self.n
        fit = every.filter(F.size("x") == d)
        sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()  # d rows
        self.sums = np.array([r["s"] for r in sums], np.int64)
        self.floor, self.rest = self.sums // n, self.sums % n
        reach = max(max(r["high"] - int(m), int(m) + 1 - r["low"]) for r, m in zip(sums, self.floor, strict=True))
        #: n * x - S fits a long, and so do the sums of its squares.
        self.fits, self.squares_fit = reach * n < 1 << 62, d * (reach * n) ** 2 < 1 << 63
        centred = self.centred()

        def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return np.array([[sum(float((centred(x) ** 2).sum()) for _, x in _blocks(batches, "x", d))]])

        self.trace = float(_summed(fit, ["double"], squares)[0, 0]) / n

        def product(v: np.ndarray) -> np.ndarray:
            def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                out = np.zeros(v.shape)
                for _, x in _blocks(batches, "x", d):
                    c = centred(x)
                    out += c.T @ (c @ v)
                return out

            return _summed(fit, ["double"] * v.shape[1], work) / n

        if self.trace == 0:
            return
        self.pairs = block_lanczos(product, d, components, block, most, tolerance, seed=seed)
        varies = self.pairs.values > LEAST_SHARE * self.pairs.values[0]
        self.values, self.vectors = self.pairs.values[varies], self.pairs.vectors[:, varies]
        turn, k = self.vectors / np.sqrt(self.values), len(self.values)

        def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((k + 1, k))
            for _, x in _blocks(batches, "x", d):
                w = centred(x) @ turn
                out[:k] += w.T @ w
                out[k] += w.sum(axis=0)
            return out

        found = _summed(fit, ["double"] * k, spread) / n
        self.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S / n as doubles, from exact integers where they fit."""
        n, floor, rest, fits = self.n, self.floor, self.rest, self.fits

        def run(x: np.ndarray) -> np.ndarray:
            return ((x - floor) * n - rest) / n if fits else (x - floor) - rest / n

        return run

    def deviations(self) -> Callable[[np.ndarray], list[int | None]]:
        """The sum of (n * x - S)^2 of each row, exact; null beyond a long."""
        n, floor, rest, plain = self.n, self.floor, self.rest, self.squares_fit

        def run(x: np.ndarray) -> list[int | None]:
            if plain:
                return (((x - floor) * n - rest) ** 2).sum(axis=1).tolist()
            y = ((x - floor).astype(object) * n - rest.astype(object)) ** 2
            return [int(s) if s < 1 << 63 else None for s in y.sum(axis=1)]

        return run

    def transform(self) -> DataFrame:
        """A row for each kept row and component: OUT."""
        d, n, k, error = self.d, self.n, len(self.values), self.identity_error
        if not k:
            return self.rows.sparkSession.createDataFrame([], OUT)
        turn, explained = self.vectors / np.sqrt(self.values), self.values / self.trace
        centred, deviations = self.centred(), self.deviations()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, x in _blocks(batches, "x", d):
                m = len(x)
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    some.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(again),
                    pa.array((centred(x) @ turn).reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

        return self.rows.filter(F.size("x") == d).mapInArrow(run, OUT)


def whitened(vectors: DataFrame, column: str = "embedding", **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return Whitening(vectors, column, **options).transform()
