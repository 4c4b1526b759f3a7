"""Embedding whitening from a bit-sliced scatter matrix (operator 13)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import kept_table
from joblog.llm.vectors import finite_vectors

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
# Components below this magnitude keep every exact sum within a decimal of 38 digits.
BELOW = float(1 << 30)
# Vectors whose bit planes are packed at once: a multiple of 64.
AT_ONCE = 4096
# Whole numbers below this bound cannot overflow a long in the sums of AT_ONCE vectors.
NARROW = 1 << 24
_LONG = (1 << 63) - 1


def whole(found: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * found).astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> np.ndarray:
    """(bit, dimension, word) planes of the non-negative whole numbers ``y (row, dimension)``, 64 rows a word."""
    rows, dims = y.shape
    words = -(-rows // 64)
    top = int(y.max()).bit_length() if y.size else 0
    out = np.zeros((top, dims, 8 * words), np.uint8)
    for bit in range(top):
        packed = np.packbits((y >> bit & 1).astype(np.uint8), axis=0).T
        out[bit, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the rows of ``x``, exact.

    Every dimension is shifted by its least value and cut into bit planes packed
    across rows. The product of two dimensions is then a sum of counts: of the
    rows that have bit a of one and bit b of the other, times 2**(a+b). The
    shifts are put back at the end.
    """
    kind = np.int64 if np.abs(x).max(initial=0) < NARROW else object
    rows, dims = x.shape
    low = x.min(axis=0)
    planes = bit_planes(x - low)
    weights = np.array([1 << b for b in range(len(planes))], kind)
    sums = (np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(kind) * weights[:, None]).sum(axis=0)
    products = np.zeros((dims, dims), kind)
    for i in range(dims):
        for bit, plane in enumerate(planes[:, i]):
            if plane.any():
                both = np.bitwise_count(planes[:, i:] & plane).sum(axis=2, dtype=np.int64).astype(kind)
                products[i, i:] += (both * weights[:, None]).sum(axis=0) * weights[bit]
    products = products + np.triu(products, 1).T
    shift = low.astype(kind)
    products = products + np.outer(sums, shift) + np.outer(shift, sums) + rows * np.outer(shift, shift)
    return sums + rows * shift, products


def common_dims(vectors: DataFrame) -> int:
    """The length that most vectors without null or non-finite entries have; the longer among equals, 0 without any."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < BELOW)), F.lit(False))
    top = vectors.filter(sound & (F.size(e) > 0)).groupBy(F.size(e).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return top.dims if top else 0


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # falling eigenvalues of the covariance
    axes: np.ndarray  # their unit eigenvectors, as columns
    trace: float
    exact: np.ndarray  # which eigenvalues are above rounding


def fit(vectors: DataFrame, dims: int) -> Fit:
    """The covariance of all vectors, from sums that are whole numbers to the end, and its eigenvectors.

    A task sends one row of sums a dimension; the driver receives one total row
    a dimension, whatever the number of vectors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            x = whole(finite_vectors(batch.column("embedding"), dims, BELOW)[1])
            n += len(x)
            for low in range(0, len(x), AT_ONCE):
                s, p = scatter(x[low : low + AT_ONCE])
                sums, products = sums + s.astype(object), products + p.astype(object)
        exact = pa.decimal128(38, 0)
        rows = [pa.array([Decimal(int(v)) for v in row], exact) for row in products] if n else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), n, np.int64)),
                pa.array([Decimal(int(s)) for s in sums[: len(rows)]], exact), pa.array([r.to_pylist() for r in rows], pa.list_(exact)),
            ],
            ["dim", "n", "total", "products"],
        )

    tasks = vectors.select("embedding").mapInArrow(run, "dim int, n long, total decimal(38,0), products array<decimal(38,0)>")
    every = tasks.groupBy("dim").agg(F.sum("n"), F.sum("total"), *[F.sum(F.get("products", F.lit(j))) for j in range(dims)])
    rows = sorted(every.collect())  # one row a dimension
    n, sums = rows[0][1], [int(r[2]) for r in rows]
    square = n * n
    # Centred as whole numbers; the only rounding is the one division.
    cov = np.array([[(n * int(rows[i][3 + j]) - sums[i] * sums[j]) / square for j in range(dims)] for i in range(dims)])
    trace = sum(n * int(rows[i][3 + i]) - sums[i] ** 2 for i in range(dims)) / square
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return Fit(n, sums, values, axes, trace, values > 16 * dims * np.finfo(float).eps * trace)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Fit | None]:
    """(vec_id, deviation_exact, z) of ``vectors (vec_id, embedding)``, stored, and the fit; z has up to ``components`` values.

    An entry c counts as floor(1024 * c) + 100000. Vectors that are null, empty,
    or hold an entry that is null, not finite or of magnitude ``BELOW`` or more
    are left out, and so are those that differ in length from most others. The
    fit is over all that remain, repeated rows included. Components go by falling
    eigenvalue, equal ones in the order of the solver; where the eigenvalue is
    zero up to rounding, as with a single vector, z is null. An empty table has
    no fit and no rows. Null ids are carried along; other columns are not read.
    """
    dims = common_dims(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, deviation_exact decimal(38,0), z array<double>"
    if not dims:
        return vectors.sparkSession.createDataFrame([], shape), None
    model = fit(vectors, dims)
    n, count = model.n, min(components, dims)
    scaled = np.where(model.exact[:count], 1 / np.sqrt(np.where(model.exact, model.values, 1.0)[:count]), np.nan)
    onto = model.axes[:, :count] * scaled

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = finite_vectors(batch.column("embedding"), dims, BELOW)
            x = whole(found)
            narrow = n * int(np.abs(x).max(initial=0)) < 1 << 62
            gap = (n * x if narrow else n * x.astype(object)) - np.array(model.sums, np.int64 if narrow else object)
            small = int(np.abs(gap).max(initial=0)) ** 2 * dims <= _LONG
            squares = (gap * gap).sum(axis=1) if small else (gap.astype(object) ** 2).sum(axis=1)
            z = (gap / n).astype(np.float64) @ onto
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)), pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares], pa.decimal128(38, 0)),
                    pa.array([[None if v != v else v for v in r] for r in z.tolist()], pa.list_(pa.float64())),
                ],
                ["vec_id", "deviation_exact", "z"],
            )

    return kept_table(vectors.select("vec_id", "embedding").mapInArrow(run, shape), "whitened"), model


def identity_error(told: DataFrame, usable: list[int]) -> float | None:
    """The largest entry, in magnitude, of the covariance of the ``usable`` whitened components less the identity."""
    z = {i: F.get("z", F.lit(i)) for i in usable}
    pairs = [(i, j) for i in usable for j in usable if i <= j]
    if not pairs:
        return None
    found = told.agg(*[F.covar_pop(z[i], z[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whitening_report(vectors: DataFrame) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    ``deviation`` is null where it exceeds a long; ``deviation_exact`` is not
    (null only beyond 38 digits). Explained is null if no vector differs.
    """
    told, model = whitened(vectors)
    count = min(COMPONENTS, len(model.sums)) if model else 0
    error = identity_error(told, [i for i in range(count) if model.exact[i]]) if model else None
    shares = [max(float(v), 0.0) / model.trace if model.trace else None for v in model.values[:count]] if model else []
    explained = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    long = (F.col("deviation_exact") <= _LONG, F.col("deviation_exact").cast("long"))
    rows = told.select("vec_id", F.lit(model.n if model else 0).cast("long").alias("n"), "deviation_exact", F.when(*long).alias("deviation"), F.posexplode("z").alias("i", "whitened"))
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )
