"""Whitening of embeddings along their principal components, by Jacobi-Davidson.

Vectors are counted in steps of 1/1024 (``x = floor(1024 * c) + 100000``), so that sums
and deviations are exact integers. The covariance is never formed: a product with it is one
pass of Spark over the centred rows, each task adding up ``y (y . q)`` for a block of
vectors ``q``, and only sums of the length of a vector come back.

The components are found on a growing subspace. Each round takes the eigenpairs of the
covariance on the subspace (Rayleigh-Ritz), and for each wanted pair that is not exact yet
solves the correction equation, projected off the pairs found, by a few MINRES steps; the
solvers of all pairs go in step, so that a pass serves them all. Corrections widen the
subspace, which is cut back to its best part when it gets wide. A pair whose residual is
down at double precision is locked, in order, and everything after is kept orthogonal to
it. At the end one more pass over directions outside looks for a larger eigenvalue missed.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.storage import stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 53
INNER = 8
_EPS = float(np.finfo(np.float64).eps)
_SAFE = 1 << 61
_LOW = 20

Product = Callable[[np.ndarray], np.ndarray]


class Fit(NamedTuple):
    """What is known of all rows of one length; ``axes`` has a column per component."""
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float
    passes: int


def stepped(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dim, x binary)``, staged, of the rows that can be used.

    ``x`` is 32-bit integers where they fit, else 64-bit; values beyond 2^53 stop there.
    """
    v = F.col("v")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            with np.errstate(over="ignore"):
                steps = np.clip(np.floor(column.flatten().to_numpy() * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
            cells = []
            for part in np.split(steps, np.cumsum(sizes)[:-1]):
                small = not len(part) or -(1 << 31) <= part.min() and part.max() < 1 << 31
                cells.append(part.astype("<i4" if small else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes.astype(np.int32)), pa.array(cells, pa.binary())],
                                             names=["vec_id", "dim", "x"])

    return stage(rows.mapInArrow(run, f"vec_id {kind}, dim int, x binary"), "stepped")


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    cells = column.to_pylist()
    if all(len(c) == 4 * dim for c in cells):
        return np.frombuffer(b"".join(cells), "<i4").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(c, "<i4" if len(c) == 4 * dim else "<i8") for c in cells], np.int64).reshape(-1, dim)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, as 64-bit integers where they fit, else as Python's."""
    if x.size and n * int(np.abs(x).max()) < _SAFE and max(map(abs, sums)) < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(column: pa.Array, dim: int, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(_numbers(column, dim), n, sums).astype(np.float64) / n


def _moments(rows: DataFrame, dim: int) -> list[int]:
    """Exact sums per dimension; they travel in two halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _numbers(batch.column("x"), dim)
            high += (x >> _LOW).sum(axis=0)
            low += (x & ((1 << _LOW) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    got = rows.select("x").mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return [(r["high"] << _LOW) + r["low"] for r in got.orderBy("i").collect()]  # a row per dimension


def _summed(rows: DataFrame, partial: Callable[[pa.Array], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``partial`` over all batches; rows of it meet in Spark, and ``shape`` comes back."""
    names = [f"p{j}" for j in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column("x"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), *(pa.array(c) for c in total.T)], names=["i", *names])

    schema = ", ".join(["i int", *(f"{c} double" for c in names)])
    got = rows.select("x").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    table = got.toArrow()  # a row per dimension
    return np.column_stack([table.column(c).to_numpy() for c in names])[np.argsort(table.column("i").to_numpy())]


def fit(rows: DataFrame, dim: int, n: int, components: int = COMPONENTS) -> Fit:
    """Components of the staged rows (``stepped``) of length ``dim``, of which there are ``n``."""
    sums = _moments(rows, dim)
    squares = _summed(rows, lambda c: (_centred(c, dim, n, sums) ** 2).sum(axis=0)[:, None], (dim, 1))
    trace, passes = float(squares.sum()) / n, 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def partial(column: pa.Array) -> np.ndarray:
            y = _centred(column, dim, n, sums)
            return y.T @ (y @ q)

        return _summed(rows, partial, q.shape) / n

    values, axes = jacobi_davidson(product, dim, components) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    k, error = len(values), 0.0
    if k:
        onto = axes / np.sqrt(values)

        def spread(column: pa.Array) -> np.ndarray:
            white = np.column_stack([_centred(column, dim, n, sums) @ onto, np.ones(len(column))])
            return white.T @ white

        moments = _summed(rows, spread, (k + 1, k + 1)) / n
        error = float(np.abs(moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k]) - np.eye(k)).max())
    return Fit(n, sums, values, axes, trace, error, passes)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    A row per usable row of ``vectors(vec_id, embedding)`` and component, from 1 by falling
    variance. A vector that is null or holds a null or non-finite entry is dropped, an empty
    one has no components. Vectors of each length are fitted on their own. Repeated rows and
    null ids count and come out row by row; other columns are not read. Components without
    variance cannot be whitened and are left out, so equal vectors, a single vector and an
    empty table give no rows. ``deviation`` is null where it exceeds a long.
    """
    rows = stepped(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = vectors.sparkSession.createDataFrame([], schema)
    for row in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # a row per vector length
        own = rows.where(F.col("dim") == row["dim"])
        out = out.union(own.select("vec_id", "x").mapInArrow(_projector(row["dim"], fit(own, row["dim"], row["n"], components)), schema))
    return out


def _projector(dim: int, found: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.values)
        onto = found.axes / np.sqrt(found.values)
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 4096):
                part = batch.slice(at, 4096)
                exact = _deviations(_numbers(part.column("x"), dim), found.n, found.sums)
                white = exact.astype(np.float64) / found.n @ onto
                if exact.dtype == object or float(np.abs(exact).max()) ** 2 * dim >= _SAFE:
                    totals = (exact.astype(object) ** 2).sum(axis=1).tolist()
                    deviation = [t if t < 1 << 63 else None for t in totals]
                else:
                    deviation = (exact ** 2).sum(axis=1)
                rows = len(white)
                take = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, found.n)), pa.array(deviation, pa.int64()).take(take), pa.array(white.ravel()),
                     pa.array(np.tile(found.values / found.trace, rows)), pa.array(np.full(rows * k, found.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def jacobi_davidson(product: Product, dim: int, want: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric non-negative matrix, largest first.

    At most ``want``; those that are zero to double precision are left out. ``product`` gives
    the matrix times a block of columns.
    """
    want = min(want, dim)
    start = min(dim, 4 * want + 8)
    widest = min(dim, start + 6 * want)
    draw = np.random.default_rng(13)
    locked, values = np.zeros((dim, 0)), []
    basis = _joined(np.zeros((dim, 0)), draw.standard_normal((dim, start)))
    images = product(basis)
    scale, last, stalled = 0.0, np.inf, 0
    for _ in range(rounds):
        theta, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        order = np.argsort(-theta)
        theta, basis, images = theta[order], basis @ turn[:, order], images @ turn[:, order]
        scale = max([scale, *theta[:1], *values[:1]])
        exact = (32 + dim) * _EPS * scale
        residuals = images - basis * theta
        size = np.linalg.norm(residuals, axis=0)
        open_ = want - len(values)
        # At the noise of the sums a residual falls no further.
        stalled = stalled + 1 if len(size) and size[:open_].max() > last / 2 else 0
        last = size[:open_].max() if len(size) else 0.0
        done = 0
        while done < min(open_, len(theta)) and size[done] <= (exact if stalled < 3 else 64 * exact):
            done += 1
        if done:
            values += theta[:done].tolist()
            locked = np.column_stack([locked, basis[:, :done]])
            basis, images, theta, residuals = basis[:, done:], images[:, done:], theta[done:], residuals[:, done:]
            last, stalled, open_ = np.inf, 0, open_ - done
        room = dim - locked.shape[1] - basis.shape[1]
        if not open_:
            missed = _missed(product, locked, basis, values, draw, exact) if room else None
            if missed is None:
                break
            values, locked = values[:-missed.shape[1]], locked[:, :-missed.shape[1]]
            fresh = missed
        else:
            if basis.shape[1] + open_ > widest:
                basis, images = basis[:, :start], images[:, :start]
            fresh = _corrections(product, np.column_stack([locked, basis[:, :open_]]), theta[:open_], residuals[:, :open_], exact)
        fresh = _joined(np.column_stack([locked, basis]), fresh)
        if fresh.shape[1]:
            basis, images = np.column_stack([basis, fresh]), np.column_stack([images, product(fresh)])
        else:  # nothing new: take fresh images of what there is
            images = product(basis)
    else:
        raise ArithmeticError("residuals did not reach double precision")
    order = np.argsort(-np.array(values), kind="stable")
    values, axes = np.array(values)[order], locked[:, order]
    kept = values > (32 + dim) * _EPS * scale
    return values[kept], axes[:, kept]


def _joined(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal block of what ``block`` adds to the orthonormal ``basis``."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size or basis.shape[1] + out.shape[1] >= len(column):
            continue
        column, before = column / size, 1.0
        for _ in range(3):
            for other in (basis, out):
                column = column - other @ (other.T @ column)
            before = np.linalg.norm(column)
            if before < 1e-8:
                break
            column = column / before
        if before >= 1e-8:
            out = np.column_stack([out, column])
    return out


def _missed(product: Product, locked: np.ndarray, basis: np.ndarray, values: list[float], draw: np.random.Generator,
            exact: float) -> np.ndarray | None:
    """Directions outside all that is known, if the matrix stretches some of them more than the least pair found."""
    outside = _joined(np.column_stack([locked, basis]), draw.standard_normal((len(locked), 4)))
    if not outside.shape[1]:
        return None
    theta, turn = np.linalg.eigh(outside.T @ product(outside))
    return outside @ turn[:, -1:] if theta[-1] > min(values) + exact else None


def _minres(b: np.ndarray, steps: int, ratio: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Solves A x = b for a symmetric A: yields vectors, is sent A times them, returns x."""
    beta = first = float(np.linalg.norm(b))
    x, w, w_old, v_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    if not first:
        return x
    v, rest, beta = b / first, first, 0.0
    c = c_old = 1.0
    s = s_old = 0.0
    for _ in range(steps):
        image = yield v
        alpha = float(v @ image)
        image = image - alpha * v - beta * v_old
        after = float(np.linalg.norm(image))
        # The new column of the tridiagonal matrix, turned by the two last rotations.
        over, above = s_old * beta, s * alpha + c_old * c * beta
        here = c * alpha - c_old * s * beta
        pivot = float(np.hypot(here, after))
        if not pivot:
            break
        c_old, s_old, c, s = c, s, here / pivot, after / pivot
        w_old, w = w, (v - over * w_old - above * w) / pivot
        x = x + c * rest * w
        rest = -s * rest
        if abs(rest) <= ratio * first or after <= _EPS * first:
            break
        v_old, v, beta = v, image / after, after
    return x


def _corrections(product: Product, known: np.ndarray, theta: np.ndarray, residuals: np.ndarray, exact: float,
                 ratio: float = 0.05) -> np.ndarray:
    """Solutions of the projected correction equations of all pairs that are not exact, in step."""
    def off(v: np.ndarray) -> np.ndarray:
        v = v - known @ (known.T @ v)
        return v - known @ (known.T @ v)

    solvers, found = {}, []
    for j in range(len(theta)):
        if np.linalg.norm(residuals[:, j]) > exact:
            solver = _minres(-off(residuals[:, j]), INNER, ratio)
            try:
                solvers[j] = solver, next(solver)
            except StopIteration as end:
                found.append(end.value)
    while solvers:
        images = product(np.column_stack([v for _, v in solvers.values()]))
        running = {}
        for (j, (solver, v)), image in zip(solvers.items(), images.T):
            try:
                running[j] = solver, solver.send(off(image - theta[j] * v))
            except StopIteration as end:
                found.append(end.value)
        solvers = running
    return np.column_stack(found) if found else np.zeros((len(known), 0))
