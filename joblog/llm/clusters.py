"""Centroid clustering by progressive search in the Walsh-Hadamard domain (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import kept_table
from joblog.llm.vectors import finite_vectors

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
# Vector components become whole numbers of this scale.
SCALE = 256
# Components below this magnitude give squared distances, in both domains, that a long holds.
BELOW = 4096.0
# Vectors searched at once; bounds the (vector, centroid) pairs in memory.
AT_ONCE = 1024


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of ``x`` (a power of two long) in whole numbers, by butterflies."""
    n, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x


def coarse_order(d: int) -> np.ndarray:
    """The coefficients by number of sign changes, coarse ones first."""
    walsh = transform(np.eye(d, dtype=np.int64))
    return np.argsort((walsh[1:] != walsh[:-1]).sum(axis=0), kind="stable")


def coefficients(x: np.ndarray) -> np.ndarray:
    """The transform of ``x``, rows filled up with zeros to a power of two, coarse coefficients first."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    filled = np.zeros((len(x), d), np.int64)
    filled[:, : x.shape[1]] = x
    return transform(filled)[:, coarse_order(d)]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the centroid nearest to each row; the smaller number among equals.

    Both sides are ``coefficients``. A sum over the coarser coefficients never
    exceeds the whole distance, so a centroid whose sum is strictly above the
    whole distance of another one is out. At each level the centroid with the
    least sum gives that bound; those left are summed to the last coefficient.
    """
    n, d = x.shape
    row, cen = np.repeat(np.arange(n), len(centroids)), np.tile(np.arange(len(centroids)), n)
    part = np.zeros(len(row), np.int64)
    bound = np.full(n, np.iinfo(np.int64).max)
    low, high = 0, 1
    while low < d:
        gap = x[row, low:high] - centroids[cen, low:high]
        part += (gap * gap).sum(axis=1)
        if high < d:
            head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(part, head)
            lead = np.flatnonzero(part == least[row])
            lead = lead[np.unique(row[lead], return_index=True)[1]]
            rest = x[:, high:] - centroids[cen[lead], high:]
            bound = np.minimum(bound, part[lead] + (rest * rest).sum(axis=1))
            left = part <= bound[row]
            row, cen, part = row[left], cen[left], part[left]
        low, high = high, min(2 * high, d)
    whole = np.full((n, len(centroids)), np.iinfo(np.int64).max)
    whole[row, cen] = part
    best = whole.argmin(axis=1)
    return best, whole[np.arange(n), best] // d  # the transform stretches squares d-fold, exactly


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vectors (vec_id, embedding)`` as (vec_id, x): ``dims`` whole numbers floor(scale * component) in four bytes each; stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = finite_vectors(batch.column("embedding"), dims, BELOW)
            x = np.floor(scale * found).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "x"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return kept_table(vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, x binary"), "vectors")


def first_centroids(whole: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, at most ``clusters``."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    picked = whole.orderBy(draw, "x").limit(clusters).select("x").collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in picked], np.int64).reshape(-1, dims)


def moved_centroids(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of each cluster's mean; a centroid without vectors stays.

    A task sends one row of sums for each cluster it has seen, however many
    vectors a cluster has.
    """
    k, dims = centroids.shape
    targets = coefficients(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                x = _matrix(batch.column("x").slice(low, AT_ONCE), dims)
                best, _ = nearest(coefficients(x), targets)
                np.add.at(sums, best, x)
                counts += np.bincount(best, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    tasks = whole.select("x").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = tasks.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(i))) for i in range(dims)])
    out = centroids.copy()
    for cluster, n, *sums in total.collect():  # at most one row a cluster
        out[cluster] = [s // n for s in sums]
    return out


def clustered(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of ``vectors (vec_id, embedding)``, stored, and the final centroids.

    Vectors with exactly ``dims`` components count, each component c as the
    whole number floor(scale * c). Vectors that are null, of another length, or
    hold a component that is null, not finite or of magnitude ``BELOW`` or more
    (its squares leave the range of a long) are left out. Centroids start as
    the vectors with the smallest seeded hash of their id, equal ids by their
    numbers; a null id is hashed as ``null``. ``rounds`` times every vector goes
    to the nearest centroid, the smaller number among equals, and centroids move
    to the floor of the exact mean; empty ones stay. Repeated rows are vectors
    of their own. Fewer vectors than ``clusters`` give as many centroids; an
    empty table has none. Other columns are not read.
    """
    whole = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(whole, dims, clusters, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved_centroids(whole, centroids)
    targets = coefficients(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                best, distance = nearest(coefficients(_matrix(part.column("x"), dims)), targets)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return kept_table(whole.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clustered"), centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (null inertia: beyond a long)."""
    told, centroids = clustered(vectors)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    each = told.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    every = each.agg(F.try_sum("cluster_inertia"), F.count_if(F.col("cluster_inertia").isNull())).first()
    inertia = F.lit(None if every[1] else every[0]).cast("long").alias("inertia")
    facts = F.broadcast(named.join(each, "cluster"))  # one row a cluster
    return told.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")
