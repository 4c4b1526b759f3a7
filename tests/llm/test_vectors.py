from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from joblog.llm import clusters, whitening

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("distance", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("x", T.StringType()),
        T.StructField("z", T.StringType()),
    ]
)


def vector_rows(n=150, dims=64):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(6, dims))
    rows = [(i, [float(v) for v in heads[i % 6] * 0.3 + rng.normal(size=dims) * 0.1], i % 3) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (None, rows[2][1], 1), (rows[3][0], rows[4][1], 2)]  # repeats, null ids, one id with two vectors
    rows += [(900, None, 1), (901, [], 1), (902, [0.5] * (dims - 1), 1), (903, [0.5] * (dims - 1) + [None], 1), (904, [math.nan] + [0.1] * (dims - 1), 1)]
    rows += [(905, [math.inf] + [0.1] * (dims - 1), 1), (906, [0.0] * dims, 1), (907, [-0.25] * dims, 1), (908, [1e300] + [0.1] * (dims - 1), 1), (909, [0.1] * (dims + 1), 1)]
    return [(*r, *["clash"] * 6) for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(5)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")


def sound(v, dims, below):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < below for c in v)


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if sound(v, 64, clusters.BELOW)]
    draw = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [r[1] for r in draw[:k]]

    def assign():
        c = np.array(centroids, dtype=np.int64)
        out = []
        for i, x in kept:
            d = ((c - np.array(x)) ** 2).sum(axis=1)
            out.append((i, int(d.argmin()), int(d.min()), x))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for _, c, _, x in assign():
            members[c].append(x)
        for c, xs in members.items():
            centroids[c] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    told = assign()
    inertia = Counter()
    for _, c, d, _ in told:
        inertia[c] += d
    total = sum(inertia.values())
    return Counter((i, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d, _ in told)


@pytest.mark.parametrize("name", ["vectors", "given"])
def test_clusters(name, request):
    df = request.getfixturevalue(name)
    want = brute_clusters([(r.vec_id, r.embedding) for r in df.collect()])
    assert Counter(tuple(r) for r in clusters.cluster_report(df).collect()) == want


def test_few_and_no_vectors(spark, vectors):
    few = vectors.filter("vec_id < 7")
    want = brute_clusters([(r.vec_id, r.embedding) for r in few.collect()])
    assert Counter(tuple(r) for r in clusters.cluster_report(few).collect()) == want
    none = vectors.limit(0)
    assert clusters.cluster_report(none).collect() == [] and whitening.whitening_report(none).collect() == []
    assert clusters.cluster_report(none).columns == clusters.cluster_report(few).columns
    assert whitening.whitening_report(none).dtypes == whitening.whitening_report(few).dtypes


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    for d in (1, 3, 64):
        x, c = rng.integers(-900, 900, (50, d)), rng.integers(-900, 900, (9, d))
        c[4] = c[2]  # ties go to the smaller number
        best, distance = clusters.nearest(clusters.coefficients(x), clusters.coefficients(c))
        whole = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (best == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_largest_components_do_not_overflow():
    big = int(clusters.BELOW * clusters.SCALE) - 1
    x = np.array([[big, -big] * 32, [-big - 1, big] * 32])
    best, distance = clusters.nearest(clusters.coefficients(x), clusters.coefficients(x[::-1].copy()))
    assert best.tolist() == [1, 0] and distance.tolist() == [0, 0]
    _, far = clusters.nearest(clusters.coefficients(x[:1]), clusters.coefficients(x[1:]))
    assert far.tolist() == [sum(int(a - b) ** 2 for a, b in zip(x[0], x[1], strict=True))]


@pytest.mark.parametrize("spread", [1, 900, 1 << 20, 1 << 38])
def test_scatter_is_exact(spread):
    rng = np.random.default_rng(spread % 97)
    x = rng.integers(-spread, spread + 1, (131, 9)) + whitening.OFFSET
    x[:, 3], x[:, 5] = 7, x[:, 4]
    sums, products = whitening.scatter(x)
    rows = x.astype(object)
    assert sums.tolist() == rows.sum(axis=0).tolist()
    assert products.tolist() == (rows.T @ rows).tolist()


def brute_whitening(rows, dims):
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if sound(v, dims, whitening.BELOW)]
    x = np.array([v for _, v in kept], dtype=object)
    n, s = len(kept), x.sum(axis=0)
    gap = n * x - s
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in gap.T @ gap])
    return kept, n, (gap * gap).sum(axis=1), cov, np.array([[float(Fraction(int(v), n)) for v in row] for row in gap])


@pytest.mark.parametrize("name", ["vectors", "given"])
def test_whitening(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    kept, n, deviation, cov, centred = brute_whitening(rows, 64)
    got = whitening.whitening_report(df).collect()
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter((i, k, n, int(d)) for (i, _), d in zip(kept, deviation, strict=True) for k in range(1, 9))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    share = {r.component: r.explained for r in got}
    assert [share[k] for k in range(1, 9)] == pytest.approx((values[:8] / np.trace(cov)).tolist(), rel=1e-9)
    z = centred @ axes[:, :8] / np.sqrt(values[:8])
    for k in range(8):
        want = sorted(np.abs(z[:, k]).tolist())
        assert sorted(abs(r.whitened) for r in got if r.component == k + 1) == pytest.approx(want, rel=1e-6, abs=1e-6)
    # One sign for all rows: products of rows agree with those of the other solver.
    mine = defaultdict(dict)
    for r in got:
        mine[r.component].setdefault(r.vec_id, r.whitened)
    ids = [i for i, _ in kept]
    if len(set(ids)) == len(ids):
        for k in range(8):
            a = np.array([mine[k + 1][i] for i in ids])
            assert abs(abs(a @ z[:, k]) / n - 1) < 1e-6


def test_whitening_of_flat_and_single_vectors(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.whitening_report(one).collect()
    assert [tuple(r)[:7] for r in got] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whitening_report(flat).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and got[0].identity_error < 1e-12
    assert {r.component: round(r.explained, 12) for r in got} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float((i % 2) * (1 << 29)), 0.0]) for i in range(10)]
    got = whitening.whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and {int(r.deviation_exact) for r in got} == {(5 * (1 << 39)) ** 2}
