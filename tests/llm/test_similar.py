from __future__ import annotations

import itertools
import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose
from tests.llm.test_near import union

from joblog.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """Least place of each text's group: shingle sets of Jaccard 0.8 or more link, as do texts without a word."""
    sets = [shingles(t) for t in texts]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return union(range(len(texts)), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(sets[i], sets[j])])


def copies(rng, groups):
    """Texts with changed, cut and moved words, few of them identical."""
    out = []
    for _ in range(groups):
        base = prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 6)):
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 2)] = rng.choice([["zz"], ["qq", "ww"], []])
            out.append(" ".join(w))
    return [*out, "", None, "one two", "One  two", "one two three"]


@pytest.mark.parametrize("sample", [0, 2000])
def test_stage_keeps_one_of_each_similar_group(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash, "ORDER_SAMPLE", sample)
    texts = copies(random.Random(sample), 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(brute_groups(texts).values()))
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == want
    prints = [simhash.majority(simhash.shingle_hashes(t)) for t in texts]
    far = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() > 3]
    assert any(5 * len(shingles(texts[i]) & shingles(texts[j])) >= 4 * len(shingles(texts[i]) | shingles(texts[j])) for i, j in far)


def test_stage_on_given_documents(spark, small):
    docs = small.orderBy("doc_id").collect()
    root = brute_groups([r.text for r in docs])
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, small, "").collect()) == sorted({docs[i].doc_id for i in root.values()})


def test_rows_are_picked_not_ids(spark):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (3, c), (3, b + " end"), (None, d), (None, d), (None, c), (4, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert len(got) == 4 and set(got) == {(1, a), (2, b), (3, c), (None, d)}


def test_the_trie_join_finds_links_of_its_own(spark, monkeypatch):
    rng = random.Random(8)
    base = [prose(rng, 150).split() for _ in range(40)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:140]) for w in base] + [" ".join([*w[:70], "other", *w[71:]]) for w in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Without the prefix filter.
    monkeypatch.setattr(simhash, "_met", lambda rows, *_: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    left = sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect())
    assert len(left) < 44 and set(left) >= set(brute_groups(texts).values())


@pytest.mark.parametrize("hot", [4, 1 << 20])
def test_trie_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROOT", hot)
    monkeypatch.setattr(simhash, "NODES", 50)
    rng = random.Random(hot)
    prints = [0, (1 << 64) - 1, 0]
    for _ in range(70):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 4, 9, 12, 13]))) for _ in range(rng.randint(1, 5))]
    rows = [(i, p - (1 << 64) if p >> 63 else p, rng.choice([80, 100, 101])) for i, p in enumerate(prints)]
    got = {tuple(r) for r in simhash.trie_pairs(spark.createDataFrame(rows, "node long, fp long, n long")).collect()}
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    mates = {(first[p], i) for i, p in enumerate(prints) if first[p] != i}
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    like = {(a, b) for a, b in itertools.combinations(first.values(), 2) if apart(a, b) <= 12 and {rows[a][2], rows[b][2]} != {80, 101}}
    assert mates <= got <= mates | like
    for x in first.values():
        near = [(a, b) for a, b in like if x in (a, b)]
        if near:
            assert min(near, key=lambda e: (apart(*e), sum(e))) in got and min(near, key=sum) in got
