"""SimHash near-duplicates by a binary trie self-join (operator 8), and one document of each group of similar ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import components, kept_table, sketch, sketched, small_batches, stored

SEED = 42
BUDGET = 3
# Shingles whose bits are counted at once.
SLICE = 1 << 16
# Fingerprints below one trie root from which the root's subtrees are dealt out as node pairs.
HOT_ROOT = 4096
# Rows a task takes from its sorted partition at once, up to the end of a root.
TAKE = 1 << 17
# Node pairs with at most this many leaf pairs are compared leaf by leaf.
LEAVES = 16
# Node pairs that go down a trie at once; the others wait.
NODES = 1 << 17
# Documents are similar if their sets of five-word shingles have at least this percentage of their union in common.
SIMILAR_WORDS = 5
SIMILAR_PERCENT = 80
# Differing bits up to which fingerprints of shingle sets make a candidate pair: at Jaccard 0.8 about 10 of 64 differ.
SIMILAR_BITS = 12
# Documents that tell which shingles are common; they order the shingles and decide nothing.
ORDER_SAMPLE = 2000
# Bits of the sketch of candidate documents: 8 MiB at any size of the input.
SKETCH_BITS = 1 << 26


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words (all words if fewer), repeats included; empty if there is no word."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    rows = zip(*(found[i:] for i in range(words)), strict=False)
    return np.fromiter((digest(join(s), SEED) for s in rows), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp); fp is the 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _expand(a_lo, a_hi, b_lo, b_hi):
    """All (i, j), i < j, of the node pairs given by ranges."""
    wide = b_hi - b_lo
    sizes = (a_hi - a_lo) * wide
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = np.repeat(a_lo, sizes) + at // np.repeat(wide, sizes)
    j = np.repeat(b_lo, sizes) + at % np.repeat(wide, sizes)
    return i[i < j], j[i < j]


def trie_links(keys: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, errors: np.ndarray, bit: int, budget: int = BUDGET, lead: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among ``keys`` with at most ``budget`` differing bits, by traversing node pairs of the trie together.

    A node is a range of ``keys``, sorted below each root; ``errors`` has the
    bits in which the two paths differ so far. All pairs of one depth go down
    together, ``NODES`` at once: equal children keep their errors, unequal ones
    add one, and pairs over the budget, over ``lead`` in the first 16 bits, or
    with an empty side end.
    """
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    waiting = [(bit, (a_lo, a_hi, b_lo, b_hi, errors))]
    while waiting:
        bit, nodes = waiting.pop()
        if len(nodes[0]) > NODES:
            waiting.append((bit, tuple(x[NODES:] for x in nodes)))
            nodes = tuple(x[:NODES] for x in nodes)
        a_lo, a_hi, b_lo, b_hi, errors = nodes
        few = ((a_hi - a_lo) * (b_hi - b_lo) <= LEAVES) | (bit < 0)
        if few.any():
            i, j = _expand(a_lo[few], a_hi[few], b_lo[few], b_hi[few])
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            found_i.append(i[near])
            found_j.append(j[near])
            a_lo, a_hi, b_lo, b_hi, errors = (x[~few] for x in (a_lo, a_hi, b_lo, b_hi, errors))
        if not len(a_lo):
            continue
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        other = a_lo != b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, errors),
            (a_mid, a_hi, b_mid, b_hi, errors),
            (a_lo, a_mid, b_mid, b_hi, errors + 1),
            tuple(x[other] for x in (a_mid, a_hi, b_lo, b_mid, errors + 1)),
        ]
        a_lo, a_hi, b_lo, b_hi, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
        most = min(budget, lead) if bit >= 48 else budget
        live = (a_hi > a_lo) & (b_hi > b_lo) & (errors <= most) & ~((a_lo == b_lo) & (a_hi - a_lo < 2))
        if live.any():
            waiting.append((bit - 1, tuple(x[live] for x in (a_lo, a_hi, b_lo, b_hi, errors))))
    return np.concatenate(found_i), np.concatenate(found_j)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the least item it reaches by links (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            break
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
    return label


def _pairs_of(rows: dict[str, np.ndarray], front: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places in whole roots that differ in at most ``budget`` bits, rows sorted by root and key (unsigned).

    All keys of a root agree in the first ``front`` bits; the first 16 differ in ``budget`` // 4 at most.
    """
    key = rows["key"].view(np.uint64)
    head = np.stack([rows["root"], rows["pair"]])
    starts = np.flatnonzero(np.concatenate(([True], (head[:, 1:] != head[:, :-1]).any(axis=0))))
    ends = np.append(starts[1:], len(key))
    pair, depth = rows["pair"][starts], rows["depth"][starts]
    low, high = pair >> 12, pair & 4095
    a_lo, a_hi, b_lo, b_hi = starts.copy(), ends.copy(), starts.copy(), ends.copy()
    for g in np.flatnonzero(low != high):  # the two nodes of a dealt pair are neighbours in the sorted range
        node = (key[starts[g] : ends[g]] >> np.uint64(64 - front - depth[g])) & np.uint64((1 << int(depth[g])) - 1)
        a_hi[g] = b_lo[g] = starts[g] + np.searchsorted(node, np.uint64(high[g]))
    errors = np.bitwise_count(low ^ high).astype(np.int64)
    live = (a_hi > a_lo) & (b_hi > b_lo) & (ends - starts > 1)
    # Dealt nodes agree further than their root, which costs no pairs.
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in np.unique(depth[live]):
        own = live & (depth == d)
        p, q = trie_links(key, a_lo[own], a_hi[own], b_lo[own], b_hi[own], errors[own], 63 - front - int(d), budget, budget // 4)
        i.append(p)
        j.append(q)
    return np.concatenate(i), np.concatenate(j)


def _star(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fp, fp) for each component of the pairs."""
    label = least_labels(len(rows["fp"]), i, j)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return rows["fp"][moved], rows["fp"][label[moved]]


def _turned(prints: DataFrame, *columns: str) -> DataFrame:
    """``prints`` four times: ``j`` and ``key``, the fingerprint with its block ``j`` of 16 bits in front."""
    turns = F.array(*(
        F.struct(F.lit(j).alias("j"), (F.shiftleft("fp", 16 * j).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * j)) if j else F.col("fp")).alias("key"))
        for j in range(4)
    ))
    return prints.select("fp", *columns, F.inline(turns))


def _trie_join(rows: DataFrame, front: int, budget: int, hot_root: int, edges: Callable, columns: tuple[str, ...] = ()) -> DataFrame:
    """What ``edges`` makes of the pairs in each root of ``rows (fp, key, root)``, as rows (a, b).

    Roots with over ``hot_root`` fingerprints are dealt out as pairs of nodes
    4, 8 or 12 bits deeper that a block's share of the budget still allows.
    """
    hot = rows.groupBy("root").agg(F.count("*").alias("n_root")).filter(F.col("n_root") > hot_root)
    depth = F.when(F.col("n_root") <= 16 * hot_root, 4).when(F.col("n_root") <= 256 * hot_root, 8).otherwise(12)
    rows = rows.join(hot.select("root", depth.alias("depth")), "root", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    # Below a front block that agrees the whole budget is left.
    errors = budget if front else budget // 4

    def partners(bits: int) -> list[int]:
        return [x for x in range(1 << bits) if x.bit_count() <= errors]

    def dealt(bits: int):
        node = F.shiftrightunsigned("key", 64 - front - bits).bitwiseAND(F.lit((1 << bits) - 1))
        masks = F.array(*(F.lit(x).cast("long") for x in partners(bits)))
        return F.transform(masks, lambda m: F.least(node, node.bitwiseXOR(m)) * 4096 + F.greatest(node, node.bitwiseXOR(m)))

    pairs = F.when(F.col("depth") == 0, F.array(F.lit(0).cast("long")))
    for bits in (4, 8, 12):
        pairs = pairs.when(F.col("depth") == bits, dealt(bits))
    rows = rows.withColumn("pair", F.explode(pairs)).withColumn("depth", F.col("depth").cast("long"))
    rows = rows.repartition("root", "pair").sortWithinPartitions("root", "pair", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    names = ("fp", "key", "root", "pair", "depth", *columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {n: np.empty(0, np.int64) for n in names}

        def found(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = edges(rows, *_pairs_of(rows, front, budget))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held = {n: np.concatenate([held[n], batch.column(n).to_numpy()]) for n in names}
            if len(held["fp"]) < TAKE:
                continue
            last = np.flatnonzero((held["root"] != held["root"][-1]) | (held["pair"] != held["pair"][-1]))
            if len(last):
                cut = last[-1] + 1
                yield found({n: v[:cut] for n, v in held.items()})
                held = {n: v[cut:] for n, v in held.items()}
        if len(held["fp"]):
            yield found(held)

    return rows.select(*names).mapInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints of ``prints (fp)``, distinct, linked at ``BUDGET`` bits.

    Of four 16-bit blocks one is equal, so four tries are joined with
    themselves, each with another block in front; a root is a value of the
    front block. A task emits a star for each component it finds, not its pairs.
    """
    rows = _turned(prints).select("fp", "key", (F.col("j") * 65536 + F.shiftrightunsigned("key", 48)).cast("long").alias("root"))
    return _trie_join(rows, 16, BUDGET, HOT_ROOT, _star)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id): fingerprints link at ``BUDGET`` or fewer differing bits.

    component_id is the least doc_id reachable, itself included. Null and empty
    texts have fingerprint 0 and link like any other. Long texts are read whole.
    Equal fingerprints are one node, so copies cost one row each. Repeated rows
    come out as often; a null doc_id is never a component's id unless all are
    null; other columns are not read; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int, common: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text by hash, those in ``common`` (sorted) last."""
    found = np.unique(shingle_hashes(text, words))
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    late = common[at] == found
    return np.concatenate([found[~late], found[late]])


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for a set of shingles, as a signed long."""
    return xxhash.xxh3_64_intdigest(np.sort(shingles).tobytes()) - (1 << 63)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that three or more of ``ORDER_SAMPLE`` documents have, sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["gram"])

    counts = docs.select("text").limit(ORDER_SAMPLE).mapInArrow(run, "gram long").groupBy("gram").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "gram").limit(1 << 20).select("gram").toPandas()["gram"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _runs_pairs(rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of other clusters inside runs of equal ``gram``, rows sorted by gram and size, that size and place allow."""
    gram, n, at, node, cluster = (rows[c] for c in ("gram", "n", "at", "node", "cluster"))
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    ends = np.append(starts[1:], len(gram))
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        # An equal share of the union is percent / (100 + percent) of both sizes; a first shared shingle leaves what follows it.
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        fine = ((100 + percent) * most >= percent * (n[i] + n[j])) & (100 * n[i] >= percent * n[j]) & (cluster[i] != cluster[j])
        a, b = node[i[fine]], node[j[fine]]
        out_a.append(np.minimum(a, b))
        out_b.append(np.maximum(a, b))

    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
        if (cluster[s:e] != cluster[s]).any():
            for i in range(s, e - 1):
                keep(np.full(e - i - 1, i), np.arange(i + 1, e))
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
    return pairs[0], pairs[1]


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of the nodes of ``rows (gram, n, at, node, cluster)``."""
    names = ["gram", "n", "at", "node", "cluster"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0, np.int64) for c in names}

        def pairs(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = _runs_pairs(rows, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held = {c: np.concatenate([held[c], batch.column(c).to_numpy()]) for c in names}
            last = np.flatnonzero(held["gram"] != held["gram"][-1]) if len(held["gram"]) >= 1 << 14 else ()
            if len(last):
                cut = last[-1] + 1
                yield pairs({c: v[:cut] for c, v in held.items()})
                held = {c: v[cut:] for c, v in held.items()}
        if len(held["gram"]):
            yield pairs(held)

    ordered = rows.repartition("gram").sortWithinPartitions("gram", "n", "node")
    return ordered.select(*names).mapInArrow(run, "a long, b long").distinct()


def _candidates(percent: int) -> Callable:
    """Of the pairs of a task those that sizes allow, and for each node its pair with the nearest and with the least one."""

    def edges(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, node = rows["n"], rows["node"]
        fine = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        x, y = np.concatenate([i[fine], j[fine]]), np.concatenate([j[fine], i[fine]])
        apart = np.bitwise_count(rows["fp"][x].view(np.uint64) ^ rows["fp"][y].view(np.uint64))
        told = []
        for order in (np.lexsort((node[y], apart, x)), np.lexsort((node[y], x))):
            first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
            told.append(np.stack([np.minimum(node[x[first]], node[y[first]]), np.maximum(node[x[first]], node[y[first]])]))
        a, b = np.unique(np.concatenate(told, axis=1), axis=1)
        return a, b

    return edges


def trie_pairs(prints: DataFrame, percent: int = SIMILAR_PERCENT, bits: int = SIMILAR_BITS) -> DataFrame:
    """Candidate pairs (a, b) among ``prints (node, fp, n)``: fingerprints at ``bits`` or fewer differing bits, like sizes ``n``.

    One of four 16-bit blocks has at most a fourth of the errors, so four tries
    are joined with themselves, each with another block in front. A root holds
    two neighbouring classes of sizes, a class being as wide as similar sets may
    differ. Nodes of one fingerprint meet under the least of them.
    """
    first = prints.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")).select("fp", "first.*")
    mates = prints.join(first.select("fp", F.col("node").alias("a")), "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    rows = _turned(first, "n", "node").withColumn("size", F.explode(F.array(size, size + 1)))
    rows = rows.select("fp", "key", "n", "node", (F.col("size") * 4 + F.col("j")).cast("long").alias("root"))
    return _trie_join(rows, 0, bits, 4 * HOT_ROOT, _candidates(percent), ("n", "node")).unionByName(mates).distinct()


def similar_links(docs: DataFrame, words: int = SIMILAR_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Edges (a, b) of set keys that connect just the shingle sets of Jaccard similarity ``percent`` / 100 or more; exact.

    Fingerprints of the sets meet in the trie join at ``SIMILAR_BITS``, and the
    sets of these pairs are compared. What a fingerprint cannot tell is found by
    a prefix filter: in any one order of all shingles, two similar sets share
    one among the first n - ceil(n * percent / 100) + 1 of each, so those that
    the trie has not connected meet under these, common shingles last.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts, sizes, keys, prints = [np.empty(0, np.uint64)], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, words, common.value)
                n = len(found)
                if n:
                    grams.append(found[: n + percent * -n // 100 + 1])
                    counts.append(len(grams[-1]))
                    sizes.append(n)
                    keys.append(set_key(found))
                    prints.append(majority(found))
            at = np.concatenate([np.empty(0, np.int64), *(np.arange(c) for c in counts)])
            columns = [np.concatenate(grams).view(np.int64), np.repeat(np.array(sizes, np.int64), counts), at, np.repeat(np.array(keys, np.int64), counts)]
            # A set's fingerprint is one more row of it, at no place.
            own = [np.array(prints, np.uint64).view(np.int64), np.array(sizes, np.int64), np.full(len(keys), -1), np.array(keys, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(columns, own, strict=True)], ["gram", "n", "at", "node"])

    met = kept_table(docs.mapInArrow(prefixes, "gram long, n long, at long, node long").distinct(), "shingles")
    prints, rows = met.filter("at < 0").select("node", F.col("gram").alias("fp"), "n"), met.filter("at >= 0")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = kept_table(pairs, "similar-pairs")
        nodes = pairs.select(F.col("a").alias("k1")).unionByName(pairs.select(F.col("b").alias("k1")))
        held = docs.sparkSession.sparkContext.broadcast(sketch(nodes, SKETCH_BITS))

        def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
                keys = np.array([set_key(f) for f in found], np.int64)
                some = np.flatnonzero(sketched(held.value, keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array([found[i].tobytes() for i in some], pa.binary())], ["node", "grams"])

        def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = []
                for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    fine.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

        full = kept_table(docs.mapInArrow(sets, "node long, grams binary").dropDuplicates(["node"]), "shingle-sets")
        x, y = (full.select(F.col("node").alias(c), F.col("grams").alias(g)) for c, g in (("a", "x"), ("b", "y")))
        return kept_table(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "similar")

    near = checked(trie_pairs(prints, percent))
    clusters = components(near).withColumnRenamed("root", "cluster")
    rows = rows.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    return near.unionByName(checked(_met(rows, percent)))


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``docs`` plus ``_group``, the same in rows whose texts similar ones connect; texts without a word are one group."""
    roots = components(similar_links(docs, words, percent)).select(F.col("node").alias("_node"), "root")

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        return pd.Series([set_key(np.unique(shingle_hashes(t, words))) for t in text], dtype="int64")

    named = docs.withColumn("_node", key("text")).join(roots, "_node", "left")
    return named.select(*docs.columns, F.coalesce("root", "_node").alias("_group"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of ``similar_groups``: the least by doc_id (nulls last), then by text.

    Of rows that repeat one of them stays, and rows without doc_id are compared
    like any other. A row is told by 128 bits of all its columns.
    """
    marks = {"_h": F.xxhash64("text"), "_row": F.xxhash64(F.lit(1), *docs.columns)}
    ids = kept_table(similar_groups(docs.select("doc_id", "text", *(v.alias(c) for c, v in marks.items()))).drop("text"), "groups")
    first = ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_h", "_row")).alias("first"))
    kept = docs.withColumns(marks).join(first.select("first._h", "first._row"), ["_h", "_row"], "left_semi")
    return kept.dropDuplicates(["_h", "_row"]).select(*docs.columns)
