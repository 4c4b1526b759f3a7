from __future__ import annotations

import hashlib
import random
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from joblog.llm import exact
from joblog.llm.common import kept_table

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        free = 1
        for i in ids:
            kept = bool(free) and i == keep
            free -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def wanted(docs):
    return brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("name", ["edges", "small", "empty"])
def test_report(name, request):
    docs = request.getfixturevalue(name)
    assert told(exact.exact_report(docs)) == wanted(docs)


@pytest.mark.parametrize(("capacity", "key_bits"), [(4, 64), (1, 3), (2, 6), (1 << 14, 1)])
def test_full_buckets_and_colliding_keys(edges, small, capacity, key_bits):
    docs = edges.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    groups = exact.exact_groups(docs, capacity, key_bits)
    assert told(groups) == wanted(docs)
    if key_bits < 64:
        chained = groups.filter("bucket is not null").select("bucket", "link", "text_sha256").distinct().collect()
        assert max(r.link for r in chained) > 0
        assert len(chained) == len({(r.bucket, r.link, r.text_sha256) for r in chained})


def test_only_ascii_letters_are_folded(spark):
    texts = ["ÀB", "àb", "Àb", "KX", "kx", "Kx", "", None, "AbC" * 9000, "aBc" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert told(exact.exact_report(docs)) == wanted(docs)
    assert exact.exact_report(docs).filter("group_size > 1").count() == 8


def test_one_text_for_most_rows(spark):
    rows = [(i % 7 if i % 3 else None, "The same text" if i % 2 else f"text {i % 40}") for i in range(2000)] + [(None, "nobody")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    docs = kept_table(docs, "many")
    assert told(exact.exact_groups(docs, 8)) == wanted(docs)
    left = exact.without_copies(docs.withColumn("__own_note", F.lit("x")), 8)
    assert left.columns == ["doc_id", "text", "__own_note"]
    assert Counter((r.text.lower(), r.doc_id) for r in left.collect()) == Counter((t.lower(), max((i for i, u in rows if u == t and i is not None), default=None)) for t in {t for _, t in rows})


def test_directory_doubles_until_buckets_fit(spark):
    rng = random.Random(3)
    keys = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(500)] + [((1 << 62) + i,) for i in range(40)], "h long").distinct()
    pointers, depth = exact.directory(keys, 32)
    cells = {r.cell: r.bucket for r in pointers.collect()}
    placed = Counter(cells[(r.h + 0 if r.h >= 0 else r.h + (1 << 64)) >> (64 - depth) if depth else 0] for r in keys.collect())
    deepest = max(b.bit_length() for b in placed) - 1
    assert deepest == depth and len({b.bit_length() for b in placed}) > 1  # local depths differ
    # Only the bucket whose keys share all counted bits holds more.
    assert [n for n in placed.values() if n > 32] in ([], [max(placed.values())])


def test_native(edges):
    plan = exact.exact_report(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
