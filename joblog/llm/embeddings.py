"""Near-duplicate embeddings by an epsilon grid order join (operator 9)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import components, stored
from joblog.llm.simhash import least_labels

COSINE = 0.98
# Vectors from which the principal directions are found. They only steer pruning, never results.
SAMPLE = 2000
CELL_DIMS, BOX_DIMS = 4, 16
# Vectors in a sequence interval that is joined as one task's side, and in one that is compared directly.
CHUNK, BLOCK = 2048, 128


def units(vectors: Iterable[np.ndarray]) -> np.ndarray:
    """Rows of unit length in double precision, scaled first so that no square overflows."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Leading principal directions, at most ``dims``, as orthonormal columns."""
    if len(vectors) < 2:
        return np.eye(vectors.shape[1])[:, :dims]
    _, found = np.linalg.eigh(np.cov(vectors, rowvar=False).reshape(vectors.shape[1], -1))
    return found[:, ::-1][:, :dims]


def interval_links(x: np.ndarray, p: np.ndarray, a: tuple[int, int], b: tuple[int, int], least: float, eps: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j), i < j, between two intervals of the grid order, joined recursively.

    ``p`` are projections on orthonormal axes, so boxes of ``p`` that lie
    further apart than ``eps`` hold no link, and the pair of intervals is skipped.
    """
    todo = [(a, b)]
    while todo:
        (al, ah), (bl, bh) = todo.pop()
        if ah <= al or bh <= bl:
            continue
        gap = np.maximum(0, np.maximum(p[bl:bh].min(axis=0) - p[al:ah].max(axis=0), p[al:ah].min(axis=0) - p[bl:bh].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if max(ah - al, bh - bl) <= block:
            i, j = np.nonzero(x[al:ah] @ x[bl:bh].T >= least)
            i, j = i + al, j + bl
            yield i[i < j], j[i < j]
            continue
        am, bm = (al + ah) // 2, (bl + bh) // 2
        if (al, ah) == (bl, bh):
            todo += [((al, am), (al, am)), ((al, am), (am, ah)), ((am, ah), (am, ah))]
        elif ah - al >= bh - bl:
            todo += [((al, am), (bl, bh)), ((am, ah), (bl, bh))]
        else:
            todo += [((al, ah), (bl, bm)), ((al, ah), (bm, bh))]


def classes(vectors: DataFrame) -> DataFrame:
    """``vectors (vec_id, label, embedding)`` with the key (k1, k2) of equal vectors of a label; null for what links with nothing."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    sound = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    return vectors.select(
        "vec_id", "label", "embedding",
        F.when(sound, F.xxhash64("label", "embedding")).alias("k1"),
        F.when(sound, F.xxhash64(F.lit(1), "embedding", "label")).alias("k2"),
    )


def ordered_chunks(nodes: DataFrame, eps: float) -> DataFrame:
    """``nodes`` in epsilon grid order, cut into chunks of one label, with ``chunk`` and the projections ``p``; stored."""
    sample = nodes.select("embedding").orderBy(F.xxhash64("k1", "k2")).limit(SAMPLE).toPandas()
    basis = {}
    for d in sample["embedding"].map(len).unique():
        basis[int(d)] = axes(units(sample["embedding"][sample["embedding"].map(len) == d]), BOX_DIMS)

    def project(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["embedding"].map(len)
            for d in dims.unique():
                own = batch[dims == d].copy()
                p = units(own["embedding"]) @ basis.get(int(d), np.eye(int(d), min(int(d), BOX_DIMS)))
                cells = np.zeros((len(own), CELL_DIMS), np.int64)
                cells[:, : min(CELL_DIMS, p.shape[1])] = np.floor(p[:, :CELL_DIMS] / eps)
                own["dim"], own["p"] = int(d), list(p)
                for k in range(CELL_DIMS):
                    own[f"c{k}"] = cells[:, k]
                yield own

    cells = [f"c{k}" for k in range(CELL_DIMS)]
    label = nodes.schema["label"].dataType.simpleString()
    vector = nodes.schema["embedding"].dataType.simpleString()
    shape = f"k1 long, k2 long, label {label}, embedding {vector}, n long"
    placed = nodes.mapInPandas(project, f"{shape}, dim int, p array<double>, {', '.join(f'{c} long' for c in cells)}")
    tasks = max(1, -(-nodes.count() // CHUNK))
    placed = placed.repartitionByRange(tasks, "label", "dim", *cells, "k1").sortWithinPartitions("label", "dim", *cells, "k1")

    def number(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, chunk, rows, last = TaskContext.get().partitionId(), -1, CHUNK, None
        for batch in batches:
            ids = np.empty(len(batch), np.int64)
            for i, key in enumerate(zip(batch["label"], batch["dim"], strict=True)):
                if key != last or rows == CHUNK:
                    chunk, rows, last = chunk + 1, 0, key
                ids[i] = task * (1 << 32) + chunk
                rows += 1
            yield batch.drop(columns=cells).assign(chunk=ids)

    return stored(placed.mapInPandas(number, f"{shape}, dim int, p array<double>, chunk long"))


def chunk_pairs(chunks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of chunks whose boxes are no further apart than ``eps``.

    Found by an equi-join on label, dimension and the cells of the first axis
    that the boxes touch, the one side widened by ``eps``.
    """
    most = F.lit(BOX_DIMS)
    side = lambda f, i: f(F.get("p", i))
    boxes = chunks.groupBy("chunk", "label", "dim").agg(
        F.array(*(side(F.min, i) for i in range(BOX_DIMS))).alias("lo"), F.array(*(side(F.max, i) for i in range(BOX_DIMS))).alias("hi")
    )
    boxes = stored(boxes.withColumn("lo", F.slice("lo", 1, most)))
    cell = lambda x: F.floor(x / eps)
    left = boxes.select(F.col("chunk").alias("a"), "label", "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    right = boxes.select(F.col("chunk").alias("b"), "label", "dim", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    left = left.withColumn("cell", F.explode(F.sequence(cell(F.get("alo", F.lit(0))), cell(F.get("ahi", F.lit(0))))))
    right = right.withColumn("cell", F.explode(F.sequence(cell(F.get("blo", F.lit(0)) - eps), cell(F.get("bhi", F.lit(0)) + eps))))
    gaps = F.zip_with(F.arrays_zip("alo", "ahi"), F.arrays_zip("blo", "bhi"), lambda s, t: F.greatest(F.lit(0.0), t["blo"] - s["ahi"], s["alo"] - t["bhi"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + F.coalesce(g, F.lit(0.0)) * F.coalesce(g, F.lit(0.0)))
    near = left.join(right, ["label", "dim", "cell"]).filter(F.col("a") <= F.col("b")).filter(apart <= eps * eps)
    return near.select("a", "b").distinct()


def grid_links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """For ``nodes (k1, k2, label, embedding, n)``: rows (k1, k2, links, r1, r2), partial sums of linked ``n`` and an edge to a reached node."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    chunks = ordered_chunks(nodes, eps)
    pairs = stored(chunk_pairs(chunks, eps))
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    rows, block = chunks.join(sides, "chunk"), BLOCK

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chunk", "k1", "k2"], kind="stable")
        p = np.stack(rows["p"])
        order = np.lexsort((*(np.floor(p[:, k] / eps) for k in reversed(range(min(CELL_DIMS, p.shape[1])))), rows["chunk"]))
        rows, p = rows.iloc[order], p[order]
        x, n = units(rows["embedding"]), rows["n"].to_numpy()
        cut = int((rows["chunk"] == rows["a"].iat[0]).sum())
        first, second = (0, cut), (cut, len(rows)) if cut < len(rows) else (0, cut)
        links, i_all, j_all = np.zeros(len(rows), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in interval_links(x, p, first, second, cosine, eps, block):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            i_all.append(i)
            j_all.append(j)
        label = least_labels(len(rows), np.concatenate(i_all), np.concatenate(j_all))
        k1, k2, own = rows["k1"].to_numpy(), rows["k2"].to_numpy(), links > 0
        return pd.DataFrame({"k1": k1[own], "k2": k2[own], "links": links[own], "r1": k1[label][own], "r2": k2[label][own]})

    return rows.groupBy("a", "b").applyInPandas(run, "k1 long, k2 long, links long, r1 long, r2 long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors of one label link at ``cosine`` or more in double precision. Null
    labels, null or zero vectors and such with null, NaN or infinite components
    link with nothing and are kept, as vectors of other lengths are apart.
    Equal vectors of a label are one node with a count, so a common vector
    costs no pairs; links between different vectors are counted in the tasks
    that find them and leave as sums and stars. Repeated rows count as vectors
    of their own; other columns are not read; an empty table stays empty.
    """
    keyed = classes(vectors)
    nodes = stored(
        keyed.filter("k1 is not null").groupBy("k1", "k2", "label").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    )
    found = stored(grid_links(nodes.select("k1", "k2", "label", "embedding", "n"), cosine))
    edges = found.filter("k1 <> r1 or k2 <> r2").select(F.struct("k1", "k2").alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b"))
    roots = components(edges).select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root")
    sums = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    named = nodes.select("k1", "k2", "n", "least").join(roots, ["k1", "k2"], "left").join(sums, ["k1", "k2"], "left")
    named = named.withColumn("root", F.coalesce("root", F.struct("k1", "k2")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
