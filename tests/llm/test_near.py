from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from joblog.llm import common, embeddings, lines, simhash
from joblog.llm.suffixes import Grouping


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [tuple(rng.sample(range(200, 400), 2)) for _ in range(90)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union({x for e in links for x in e}, links)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\x0b\x0c\r":
        w = w.replace(s, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edges, small, empty):
    for docs in (edges, small):
        got = Counter((r.doc_id, r.fp % 2**64) for r in simhash.fingerprints(docs).collect())
        assert got == Counter((r.doc_id, fingerprint(r.text)) for r in docs.collect())
    assert simhash.simhash_report(empty).count() == 0


@pytest.mark.parametrize("hot", [4, 1 << 20])
def test_trie_join_loses_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROOT", hot)
    rng = random.Random(hot)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(30), 2)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = union(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3])
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = dict.fromkeys(signed)
    got |= {r.node: r.root for r in common.components(simhash.fingerprint_links(frame)).collect()}
    assert {n: r if r is not None else n for n, r in got.items()} == want


def test_near_duplicates(edges, small):
    for docs in (small, edges):
        rows = docs.collect()
        prints = {(i, r.doc_id): fingerprint(r.text) for i, r in enumerate(rows)}
        keys = list(prints)
        root = union(keys, [(a, b) for a, b in itertools.combinations(keys, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]) if len(rows) < 300 else {}
        least = defaultdict(list)
        for k, r in root.items():
            least[r].append(k[1])
        want = Counter((k[1], f"{prints[k]:016x}", min((x for x in least[r] if x is not None), default=None)) for k, r in root.items())
        assert Counter(map(tuple, simhash.simhash_report(docs).collect())) == want
    assert simhash.one_of_each(edges).columns == edges.columns


VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    fine, links = {}, []
    for i, (_, v, label) in enumerate(rows):
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, np.float64)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            fine[i] = x / np.abs(x).max()
    for i, j in itertools.combinations(fine, 2):
        a, b = fine[i], fine[j]
        if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
            links.append((i, j))
    count = Counter(x for e in links for x in e)
    root = union(range(len(rows)), links)
    least = defaultdict(list)
    for i, r in root.items():
        least[r].append(rows[i][0])
    return Counter((rows[i][0], count[i], min(least[root[i]]), rows[i][0] == min(least[root[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("chunk,block", [(2048, 128), (7, 2)])
def test_grid_join(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(chunk)
    rows, n = [], 0
    for label in (1, 2, 3, None):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((n, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.12], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, [float("nan")] * 3, 1), (n + 5, [float("inf"), 1.0], 1)]
    rows += [(n + 10 + i, [1.0, 2.0], 2) for i in range(9)] + [(n + 30, [2.0, 4.0], 2), (n + 31, [1.0, 2.05], 2), (n + 32, [3.0], 2), (n + 33, [4.0], 2), (n + 34, [-4.0], 2)]
    frame = spark.createDataFrame(rows, VECTORS)
    assert Counter(map(tuple, embeddings.near_vectors(frame).collect())) == brute(rows)


def test_grid_join_on_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert Counter(map(tuple, embeddings.near_vectors(frame).collect())) == brute(rows)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance():
    rng = random.Random(6)
    for _ in range(4000):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        a, b = "".join(a), "".join(b)
        for k in range(4):
            assert lines.within_edits(a, b, k) == (distance(a, b) <= k), (a, b, k)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_signature(edits):
    rng = random.Random(edits)
    for _ in range(400):
        a = [rng.choice("abcdefgh ") for _ in range(rng.randint(32, 60))]
        b = a[:]
        for _ in range(edits):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "x"])
        own = lambda s: {h for h, indexed in lines.signatures("".join(s), edits) if indexed}
        probe = lambda s: {h for h, _ in lines.signatures("".join(s), edits)}
        assert own(a) & probe(b) or own(b) & probe(a)


def brute_lines(rows, edits):
    """(doc_id, text) of what is left; one document per (doc_id, text)."""
    spots = defaultdict(list)
    for doc, text in {(d, t) for d, t in rows if d is not None and t is not None}:
        for i, line in enumerate(text.split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) >= lines.MIN_CHARS:
                spots[line].append((doc, i, text))
    by = defaultdict(list)
    for line in spots:
        by[len(line)].append(line)
    links = [(a, b) for n in list(by) for m in range(n, n + edits + 1) for a in by[n] for b in by.get(m, []) if a < b or m > n if lines.within_edits(a, b, edits)]
    classes = defaultdict(list)
    for line, root in union(spots, links).items():
        classes[root] += spots[line]
    gone = {s for c in classes.values() for s in c if s[:2] != min(c, key=lambda s: s[:2])[:2]}
    cut = lambda d, t: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i, t) not in gone)
    return Counter((d, t if d is None or t is None else cut(d, t)) for d, t in rows)


@pytest.mark.parametrize("edits,block,neighbours", [(1, 256, 32), (1, 3, 1), (2, 4, 2)])
def test_line_dedup(spark, edges, small, monkeypatch, edits, block, neighbours):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "NEIGHBOURS", neighbours)
    rng = random.Random(9)
    base = "the quick brown fox jumps over dogs and some more"
    close = [(5000 + i, "\n".join(base[:k] + rng.choice("xyz") + base[k + rng.randint(0, 1) :] for k in rng.sample(range(len(base)), 3))) for i in range(25)]
    for rows in (close, [*close, *((d + 100, t.replace("fox", "é" * 3)) for d, t in close)], [(r.doc_id, r.text) for r in small.collect()]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter((r.doc_id, r.text) for r in lines.dedup_lines(frame, edits).collect()) == brute_lines(rows, edits)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "SKETCH_BITS", 64)
    rows = [(i, f"{'word ' * (8 + i % 9)}and {i // 2 % 7} more of them") for i in range(60)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(rows, 1)


def test_line_dedup_edges(edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    rows = [(d, t) for d, t in rows]
    got = lines.dedup_lines(edges)
    assert got.count() == len(rows) and "n_removed" in got.columns
    assert Counter((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None and r.doc_id != 8) == Counter({k: v for k, v in brute_lines(rows, 1).items() if k[0] is not None and k[0] != 8})
    assert lines.dedup_lines(empty).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        parts, starts = [], []
        for _ in range(rng.randint(1, 4)):
            starts.append(len(parts))
            parts.append(0)
            a = rng.choice([1, 2, 3, 20])
            for _ in range(rng.randint(1, 4)):
                parts += [rng.randint(1, a) for _ in range(rng.randint(0, 25))] + [0]
        want = []
        for s, e in zip(starts, [*starts[1:], len(parts)], strict=True):
            seen = itertools.count()
            t = [(x, next(seen) if x == 0 else 0) for x in parts[s:e]]
            want += [s + i for i in sorted(range(e - s), key=lambda i, t=t: t[i:])]
        assert Grouping(np.array(parts), np.array(starts)).suffix_array().tolist() == want
