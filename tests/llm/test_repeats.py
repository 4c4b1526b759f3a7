from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest

from joblog.llm import repeats


def brute(rows):
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = Counter()
    for doc, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


def rows_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["edges", "small", "empty"])
def test_given_tables(name, request):
    docs = request.getfixturevalue(name)
    assert Counter(map(tuple, repeats.repeats_report(docs).collect())) == brute(rows_of(docs))


@pytest.mark.parametrize("classes", [0, 1, 64])
def test_passages_copies_and_periods(spark, monkeypatch, classes):
    monkeypatch.setattr(repeats, "SORTED_CLASSES", classes)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(90), prose(40)
    texts = [prose(30) + passage[: rng.randint(150, 500)] + prose(20) for _ in range(12)] + [passage[40:400] + other + passage[100:330]]
    texts += [passage, passage, "z" * 201, "z" * 199, "xy" * 300, "abc" * 66, prose(30) + "q" * 240 + prose(3), "m" + passage[:199], "m" + passage[:200]]
    near = prose(200)
    texts += [near[:k] + "#" + near[k + 1 :] for k in (10, 300, 420, 700)] + [other * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeats_report(docs).collect())) == brute(rows_of(docs))


def test_windows_of_one_anchor_meet():
    rng = random.Random(3)
    window = rng.randbytes(200)
    found = []
    for size in (0, 57, 400):
        data = rng.randbytes(size) + window + rng.randbytes(100)
        found.append({a for a, s, e, _ in zip(*repeats.segments(data), strict=True) if s <= size and e >= size + 200})
    assert found[0] & found[1] & found[2]


def test_grams_that_occur_twice_in_a_segment_are_seen():
    rng = random.Random(4)
    for period in (1, 2, 7, 64, 100, 136):
        data = rng.randbytes(150) + (rng.randbytes(period) * 400)[: 200 + period] + rng.randbytes(150)
        flagged = [(s, e) for _, s, e, twice in zip(*repeats.segments(data), strict=True) if twice]
        first = {a for a, s, e, _ in zip(*repeats.segments(data), strict=True) if s <= 150 and e >= 350}
        assert first and any(s <= 150 and e >= 350 + period for s, e in flagged)


def test_a_full_sketch_loses_nothing(spark, small, monkeypatch):
    monkeypatch.setattr(repeats, "SKETCH_BITS", 64)
    assert Counter(map(tuple, repeats.repeats_report(small).collect())) == brute(rows_of(small))


@pytest.mark.parametrize("ident", [None, 7])
def test_many_texts_of_one_id(spark, ident):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = prose(400), prose(900)
    # Two texts of one length and equal crc32, of which only one holds the passage.
    first = (prose(100) + passage).encode()
    second = bytearray(prose(len(first)).encode())
    want, n = zlib.crc32(first), len(second)
    bits = [i * 8 + b for i in range(n - 40, n) for b in (0, 1)]  # flips that keep ASCII

    def flipped(chosen):
        out = bytearray(second)
        for bit in chosen:
            out[bit // 8] ^= 1 << bit % 8
        return zlib.crc32(out)

    base = flipped(())
    rows, mask = [flipped((b,)) ^ base for b in bits], (1 << len(bits)) - 1
    pivots = {}
    for k, v in enumerate(rows):
        pick = 1 << k
        while v and v.bit_length() in pivots:
            w, p = pivots[v.bit_length()]
            v, pick = v ^ w, pick ^ p
        if v:
            pivots[v.bit_length()] = (v, pick)
    need, chosen = want ^ base, 0
    while need:
        w, p = pivots[need.bit_length()]
        need, chosen = need ^ w, chosen ^ p
    for k, bit in enumerate(bits):
        if chosen & mask & 1 << k:
            second[bit // 8] ^= 1 << bit % 8
    assert zlib.crc32(second) == want
    texts = [first.decode(), second.decode(), passage + prose(20), copy, copy, prose(300), copy + "x"]
    docs = spark.createDataFrame([(ident, t) for t in texts], "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeats_report(docs).collect())) == brute(rows_of(docs))


@pytest.mark.parametrize("width", [1, 2, 8, 23, 69])
def test_bands_part_all_windows_once_and_equal_ones_alike(width):
    rng = random.Random(width)
    piece = rng.randbytes(260)
    texts = [rng.randbytes(rng.randint(0, 90)) + piece[rng.randint(0, 30) : 260 - rng.randint(0, 30)] + rng.randbytes(60) for _ in range(6)] + [b"ab" * 200]
    keys = {}
    for data in texts:
        for gram, s, e, _ in zip(*repeats.segments(data), strict=True):
            starts = []
            for key, a, b in repeats.bands(data[s:e], int(gram), width):
                for w in range(a, b - 199):
                    starts.append(w)
                    assert keys.setdefault(data[s + w : s + w + 200], (int(gram), key)) == (int(gram), key)
            assert starts == list(range(e - s - 199))
