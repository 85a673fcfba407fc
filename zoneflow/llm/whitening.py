"""Whitening of vectors along their leading principal components.

Entries become whole numbers, so sums are exact and a large common offset costs no
digits: each row is centred before anything is multiplied. The covariance is never
formed. Jacobi-Davidson asks only for its product with a few vectors, which is one pass
over the rows: each task adds up its rows' part and sends one small matrix. The
correction equations of all unfinished pairs are solved side by side by MINRES, so one
pass serves them all. The driver holds the search space, whose size follows the length
of the vectors, never their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.llm.common import stored

BLOCK_BYTES = 1 << 21
INNER_STEPS = 6
OUTER_STEPS = 300
LARGEST = 2.0**62
LONG = 1 << 63
FAINT = 2.0**-40  # of the largest eigenvalue: what is below has no digits left to whiten by


@dataclass(frozen=True)
class Blocks:
    """The rows that take part, as whole numbers, many to a record."""

    rows: DataFrame
    count: int
    base: np.ndarray  # whole part of the means
    over: np.ndarray  # sums less count * base, at most half of count either way
    sums: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.sums)


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors of the covariance in columns, by falling eigenvalue."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float


def _unpack(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    ids, data = batch.column(0), batch.column(1)
    for i in range(batch.num_rows):
        yield ids[i].values, np.frombuffer(data[i].as_buffer(), dtype="<i8").reshape(-1, width)


def vector_blocks(
    vectors: DataFrame, id_col: str, vector_col: str, scale: float = 1024, offset: int = 100_000
) -> Blocks:
    """Whole numbers ``floor(scale * entry) + offset`` of the rows that take part.

    A row takes no part if its vector is NULL, empty, lacks entries that the longest
    has, or holds an entry that is NULL, not finite or too large for a whole number.
    """
    entry = F.col("vector")
    entries = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    unfit = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | ~(F.abs(c * scale) < LARGEST))
    sound = entries.where(entry.isNotNull() & ~unfit & (F.size(entry) > 0))
    width = sound.agg(F.max(F.size(entry)).alias("d")).first()["d"] or 0
    sound = sound.where(F.size(entry) == width)
    if not width:
        return Blocks(sound, 0, np.empty(0), np.empty(0), ())
    per_block = max(1, BLOCK_BYTES // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, per_block):
                part = batch.slice(start, per_block)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                whole = np.floor(scale * values).astype("<i8") + offset
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([whole.tobytes()], pa.binary())], ["ids", "data"]
                )

    kind = T.StructType(
        [T.StructField("ids", T.ArrayType(entries.schema["id"].dataType)), T.StructField("data", T.BinaryType())]
    )
    rows = stored(sound.mapInArrow(pack, kind), "vectors")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            for _, block in _unpack(batch, width):
                count += len(block)
                # Halves add up without overflow, whatever the size of the entries.
                total += (block >> 32).sum(axis=0).astype(object) * (1 << 32)
                total += (block & 0xFFFFFFFF).sum(axis=0).astype(object)
        if count:
            sums = pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([count] * width, pa.int64()), sums],
                ["dim", "n", "total"],
            )

    made = rows.mapInArrow(add, "dim int, n long, total decimal(38,0)").groupBy("dim")
    found = sorted(made.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    count, sums = found[0]["n"], tuple(int(row["total"]) for row in found)
    base = [(2 * s + count) // (2 * count) for s in sums]
    over = [s - count * b for s, b in zip(sums, base, strict=True)]
    return Blocks(rows, count, np.array(base, np.int64), np.array(over, np.float64), sums)


def _centred(block: np.ndarray, blocks: Blocks) -> np.ndarray:
    return (block - blocks.base).astype(np.float64) - blocks.over / blocks.count


def _summed(blocks: Blocks, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a matrix made from centred rows; one pass.

    A task sends the matrix once, and equal rows of it are added up on the way.
    """
    count, base, over = blocks.count, blocks.base, blocks.over
    light = Blocks(None, count, base, over, blocks.sums)
    width = blocks.width
    shape = of_rows(np.zeros((1, width))).shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, block in _unpack(batch, width):
                made = of_rows(_centred(block, light))
                total = made if total is None else total + made
        if total is not None:
            columns = [pa.array(np.ascontiguousarray(total[:, k])) for k in range(shape[1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(shape[0]), pa.int32()), *columns],
                ["at", *(f"c{k}" for k in range(shape[1]))],
            )

    names = [f"c{k}" for k in range(shape[1])]
    made = blocks.rows.mapInArrow(add, ", ".join(["at int", *(f"{c} double" for c in names)]))
    found = sorted(made.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).collect())
    return np.array([tuple(row)[1:] for row in found])


def covariance_times(blocks: Blocks, columns: np.ndarray) -> np.ndarray:
    """The covariance of all rows times some columns, in one pass."""
    return _summed(blocks, lambda rows: rows.T @ (rows @ columns)) / blocks.count


def minres(
    multiply: Callable[[np.ndarray], np.ndarray], shift: np.ndarray, space: np.ndarray,
    right: np.ndarray, steps: int, tolerance: float,
) -> np.ndarray:
    """Approximate solutions of (A - shift) x = right in the complement of ``space``.

    One system per column, all advanced by the same product; a column that is done, or
    cannot advance, stands still.
    """

    def project(x: np.ndarray) -> np.ndarray:
        return x - space @ (space.T @ x)

    right = project(right)
    first = np.linalg.norm(right, axis=0)
    going = first > 0
    v = right / np.where(going, first, 1)
    v_old, w, w_old, x = (np.zeros_like(v) for _ in range(4))
    ones = np.ones(len(first))
    c, c_old, s, s_old, beta, eta = ones, ones, 0 * ones, 0 * ones, 0 * ones, first.copy()
    for _ in range(steps):
        if not going.any():
            break
        p = project(multiply(v) - shift * v)
        alpha = np.einsum("ij,ij->j", v, p)
        p = project(p - alpha * v - beta * v_old)
        beta_new = np.linalg.norm(p, axis=0)
        # The two earlier rotations, then the one that clears the new entry.
        delta = c * alpha - c_old * s * beta
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        rho1 = np.hypot(delta, beta_new)
        going = going & (rho1 > 0)
        safe = np.where(rho1 > 0, rho1, 1)
        c_new, s_new = delta / safe, beta_new / safe
        w_new = (v - rho3 * w_old - rho2 * w) / safe
        x = np.where(going, x + c_new * eta * w_new, x)
        eta = np.where(going, -s_new * eta, eta)
        going = going & (beta_new > 0) & (np.abs(eta) > tolerance * first)
        v_old, v = v, p / np.where(beta_new > 0, beta_new, 1)
        w_old, w, beta = w, w_new, beta_new
        c_old, c, s_old, s = c, c_new, s, s_new
    return x


def _new_directions(found: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``found`` adds to ``basis``."""
    size = np.linalg.norm(found, axis=0)
    found = found[:, size > 0] / size[size > 0]
    for _ in range(2):
        found = found - basis @ (basis.T @ found)
        left, weight, _ = np.linalg.svd(found, full_matrices=False)
        found = left[:, weight > 1e-8]
    return found


def jacobi_davidson(
    multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a symmetric operator known by its products.

    A pair is locked once its residual, and those of all larger ones, are at the
    rounding error of one product: it gets no more corrections, and the others' stay
    clear of it. At the end all residuals are taken anew from a fresh product.
    """
    wanted = min(wanted, width)
    most = max(8 * wanted, 64)
    start = np.random.default_rng(1).standard_normal((width, min(width, 2 * wanted)))
    basis = np.linalg.qr(start)[0]
    image = multiply(basis)
    small = 8 * np.finfo(float).eps * np.sqrt(width)
    for _ in range(OUTER_STEPS):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        bound = small * max(abs(values[0]), abs(values[-1]))
        residual = ritz_image[:, :wanted] - ritz[:, :wanted] * values[:wanted]
        far = np.linalg.norm(residual, axis=0) > bound
        if not far.any():
            fresh = multiply(ritz[:, :wanted])
            residual = fresh - ritz[:, :wanted] * values[:wanted]
            if (np.linalg.norm(residual, axis=0) <= 2 * bound).all():
                return values[:wanted], ritz[:, :wanted]
            basis = np.linalg.qr(ritz)[0]
            image = multiply(basis)
            continue
        open_ = np.arange(wanted) >= int(np.argmax(far))
        open_ &= far
        if basis.shape[1] == width:
            # The whole space is searched: only rounding is left, so make it fresh.
            basis = np.linalg.qr(ritz)[0]
            image = multiply(basis)
            continue
        if basis.shape[1] + open_.sum() > most:
            basis, image = ritz[:, : 2 * wanted], ritz_image[:, : 2 * wanted]
        else:
            basis, image = ritz, ritz_image
        fix = minres(
            multiply, values[:wanted][open_], ritz[:, :wanted], -residual[:, open_], INNER_STEPS, 1e-3
        )
        new = _new_directions(np.hstack([fix, residual[:, open_]]), basis)[:, : width - basis.shape[1]]
        if not new.shape[1]:
            new = _new_directions(np.random.default_rng(2).standard_normal((width, 1)), basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])
    raise ArithmeticError(f"no convergence in {OUTER_STEPS} steps")


def fit(blocks: Blocks, components: int) -> Components:
    """The leading components of all rows; fewer where the rows span fewer."""
    nothing = Components(np.empty((blocks.width, 0)), np.empty(0), 0.0)
    if not blocks.count:
        return nothing
    trace = float(_summed(blocks, lambda rows: (rows * rows).sum(axis=0)[:, None]).sum() / blocks.count)
    if not trace > 0:
        return nothing
    values, vectors = jacobi_davidson(lambda x: covariance_times(blocks, x), blocks.width, components)
    kept = values > FAINT * values[0]
    vectors = vectors[:, kept]
    top = np.abs(vectors).argmax(axis=0)
    return Components(vectors * np.sign(vectors[top, range(len(top))]), values[kept], trace)


def identity_error(blocks: Blocks, model: Components) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""
    onto = model.vectors / np.sqrt(model.values)
    mean = _summed(blocks, lambda rows: (rows @ onto).sum(axis=0)[None, :]) / blocks.count

    def products(rows: np.ndarray) -> np.ndarray:
        white = rows @ onto - mean
        return white.T @ white

    return float(np.abs(_summed(blocks, products) / blocks.count - np.eye(len(model.values))).max())


def _deviations(block: np.ndarray, blocks: Blocks) -> list[int | None]:
    """Sum over the entries of (n * x - S) squared, exact; None beyond a long."""
    n, over = blocks.count, [int(x) for x in blocks.over]
    gap = block - blocks.base
    limit = (n * int(np.abs(gap).max(initial=0)) + max(map(abs, over))) ** 2 * block.shape[1]
    if limit < LONG:
        exact = n * gap - np.array(over, np.int64)
        return (exact * exact).sum(axis=1).tolist()
    exact = gap.astype(object) * n - np.array(over, dtype=object)
    return [d if d < LONG else None for d in (exact * exact).sum(axis=1)]


def whiten(
    vectors: DataFrame,
    components: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024,
    offset: int = 100_000,
) -> DataFrame:
    """Per row and component: ``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ...

    ``n`` rows take part (see ``vector_blocks`` for which), all of them fit the model.
    ``explained`` is the component's share of the variance, ``identity_error`` one figure
    for all. Components are those with a variance to divide by: fewer than asked for if the
    rows are short or span less, none, and hence no rows, if all rows are equal or there
    are none. Repeated rows and ids are rows of their own, a NULL id stays one. A
    deviation that no long holds is NULL. No other column is read.
    """
    id_type = vectors.schema[id_col].dataType
    blocks = vector_blocks(vectors, id_col, vector_col, scale, offset)
    model = fit(blocks, components)
    made = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    k = len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], made).withColumnRenamed("id", id_col)
    error = identity_error(blocks, model)
    light = Blocks(None, blocks.count, blocks.base, blocks.over, blocks.sums)
    onto, share = model.vectors / np.sqrt(model.values), model.values / model.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _unpack(batch, light.width):
                m = len(block)
                white = _centred(block, light) @ onto
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, light.count, np.int64)),
                        pa.array(_deviations(block, light), pa.int64()).take(again),
                        pa.array(white.reshape(-1)),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    made.names,
                )

    return blocks.rows.mapInArrow(rows, made).withColumnRenamed("id", id_col)
