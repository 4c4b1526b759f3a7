from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from joblog.llm import bpe, language

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["edges", "small", "empty"])
def test_equal_to_the_library(name, request, library):
    docs = request.getfixturevalue(name)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.bpe_report(docs).collect())) == want


def test_joins_anywhere_are_repaired(library):
    rng, encoder = random.Random(2), bpe.Encoder(PATH)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "don't", "é", "e\u0301", " ", "\n", "\u3000", "'", "12", "<|endoftext|>", "x", "Ünter", "--", "J\u030c", "K", "'RE", "A.", "é,", "\u0301.", "ſ", "µ²", "×÷ª", "\x85", "\xa0", "ÀÞ", "\x1c", "½"]) for _ in range(rng.randint(0, 40)))
        data = text.encode()
        ends = np.array(sorted(rng.sample(range(len(data) + 1), min(len(data), rng.randint(0, 9)))), np.int64)
        n, ids, decoded = encoder.encode(data, ends)
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False)), text


def test_common_passages_give_common_chunks():
    rng = random.Random(3)
    passage, texts = rng.randbytes(20_000), [rng.randbytes(k) for k in (300, 1701)]
    chunks = []
    for t in texts:
        data = t + passage
        ends = [0, *bpe.cuts(bpe.rolling(np.frombuffer(data, np.uint8))).tolist(), len(data)]
        chunks.append({data[a:b] for a, b in zip(ends, ends[1:], strict=False)})
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 5


def test_each_chunk_is_encoded_once(monkeypatch):
    encoder, runs = bpe.Encoder(PATH), []
    monkeypatch.setattr(encoder, "run", lambda pieces, f=encoder.run: runs.append(1) or f(pieces))
    data = b"one two three " * 10
    first = encoder.encode(data, np.array([50, 100]))
    n = len(runs)  # three chunks and what spans their joins
    assert encoder.encode(data, np.array([50, 100])) == first and len(runs) - n == n - 3


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CHUNK_MEMORY", 64)
    monkeypatch.setattr(bpe, "PART_MEMORY", 3)
    encoder, text = bpe.Encoder(PATH), "a few more words than are remembered, over and over again a few"
    for _ in range(3):
        assert encoder.encode(text.encode(), np.arange(10, 60, 10))[1] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert len(encoder.parts) <= 3 and sum(map(len, encoder.chunks)) <= 64 + len(text)


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.language_report(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert 100 < len(held) < 350
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_shares_of_a_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    one = {x: " ".join(r.text for r in docs.filter(f"lang = '{x}'").orderBy("doc_id").limit(12).collect())[:6000] for x in ("en", "de")}
    mixed = spark.createDataFrame([(1, one["en"][:6000] + " " + one["de"][:3000]), (2, one["de"])], "doc_id long, text string")
    got = {r.doc_id: {s.lang: s.share for s in r.shares} for r in language.identify(mixed, model).collect()}
    assert got[1]["en"] == pytest.approx(2 / 3, abs=0.1) and got[1]["de"] == pytest.approx(1 / 3, abs=0.1)
    assert got[2]["de"] > 0.9


def test_em_maximises_the_likelihood():
    rng = np.random.default_rng(4)
    for _ in range(20):
        p, n = rng.dirichlet(np.ones(30), 2), rng.integers(1, 9, 30).astype(float)
        _, reached = language.proportions(p, n)
        grid = max(float(n @ np.log(w * p[0] + (1 - w) * p[1])) for w in np.linspace(0, 1, 1001))
        assert reached == pytest.approx(grid, abs=0.05)


def test_language_edges(edges, empty, spark):
    got = {r.doc_id: r for r in language.language_report(edges).collect()}
    assert language.language_report(edges).count() == edges.count()
    for i in (0, 1, 2, 18):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got.values())
    assert language.language_report(empty).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(edges, nothing).collect()} == {"und"}
