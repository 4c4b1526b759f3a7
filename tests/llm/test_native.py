from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from joblog.llm import chat, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("name", ["edges", "small", "empty"])
def test_quality_report(name, request):
    docs = request.getfixturevalue(name)
    want = Counter((r.doc_id, *stats(r.text)) for r in docs.collect())
    got = quality.quality_report(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_cascade_keeps_what_no_rule_rejects(edges):
    kept = {r.doc_id for r in quality.quality_cascade(edges).filter("kept").collect()}
    plain = quality.text_stats(edges)
    none = ~F.coalesce(quality.stat_rules()[0].fails, F.lit(False))
    for rule in quality.stat_rules()[1:]:
        none = none & ~F.coalesce(rule.fails, F.lit(False))
    assert kept == {r.doc_id for r in plain.filter(none).collect()}


def test_rules_go_by_rejections_per_cost(small):
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), F.length("text") * 0, lambda a, x: a + x % 2) > 0
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("slow", slow), quality.Rule("cheap", F.length("text") > 1)]
    assert [r.name for r in quality.order_rules(quality.sample(small, 50), rules)] == ["cheap", "slow", "never"]


def highest_quotients(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if got[i] < caps[i]), key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i), default=None)
        if best is None or not weights[best]:
            break
        got[best] += 1
    return got


@pytest.mark.parametrize("weights,seats", [([5, 3, 1], 9), ([100, 1, 1, 1], 7), ([7, 7, 7], 5), ([0, 4], 3), ([13, 8, 5, 3, 2, 1, 1], 500), ([1, 1], 0)])
def test_sainte_lague_takes_highest_quotients(spark, weights, seats):
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i int, w double")
    got = mixing.sainte_lague(rows, [], "w", F.lit(seats), F.lit(10_000), ["i"]).orderBy("i").collect()
    assert [r.quota for r in got] == highest_quotients(weights, seats, [10_000] * len(weights))


def wanted_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("name", ["edges", "small", "empty"])
def test_mixture(name, request):
    docs = request.getfixturevalue(name)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    rows = mixing.mixture(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    target, taken = wanted_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(mixing.BLOCK_WORDS, 0.01 * t)
    key = lambda r: (r.doc_id or -1, r.size, r.taken, r.source or "")
    assert sorted(map(tuple, (x[:6] for x in rows)), key=repr) == sorted(map(tuple, (x[:6] for x in mixing.mixture(docs.repartition(5)).collect())), key=repr), key


def test_mixed_documents_hold_the_words_taken(small):
    taken = {r.doc_id: r.taken for r in mixing.mixture(small).collect()}
    got = Counter()
    for r in mixing.mixed_documents(small).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mixed_documents(small).columns == small.columns


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark, empty):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\h", "\\\\h", "</turn>\n", "#####", "### user:\n", "", None, "a:\nb", "\\e\\c", "</turn</turn>>", "##\\#"]
    rows = [(c, i, ("user", "assistant", "sys:\n###", None)[(i + c) % 4], t) for c in range(4) for i, t in enumerate(nasty)]
    rows += [(None, 0, "assistant", "x"), (9, None, "user", "first"), (9, 0, "user", "dup"), (9, 0, "user", "dup"), (10, 5000, "assistant", "far"), (10, 1, "user", "near")]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.chat_report(df).collect()}
    parsed = {r.conv_id: r for r in chat.format_chat(df).select("conv_id", chat.parse_chat(F.col("formatted")).alias("turns"), "formatted").collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        pairs = [(r[2] or "", r[3] or "") for r in own]
        assert [tuple(t) for t in parsed[conv].turns] == pairs
        loss = "".join(t for role, t in pairs if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in pairs)
        r = out[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(own), len(loss), len(parsed[conv].formatted))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (said, loss))
    assert chat.chat_report(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize(
    "shape,row,turns",
    [
        ("conv_id long, response string, prompt string, note string", (1, "r", "p", "n"), [("user", "p"), ("assistant", "r")]),
        ("conv_id long, system string, prompt string, response string", (1, None, "p", "r"), [("user", "p"), ("assistant", "r")]),
        ("conv_id long, instruction string, input string, output string", (1, "i", "x", None), [("user", "i"), ("user", "x"), ("assistant", "")]),
        ("conv_id long, messages array<struct<content:string,role:string>>", (1, [("hi", "user"), (None, "assistant")]), [("user", "hi"), ("assistant", "")]),
        ("conv_id long, conversations array<struct<from:string,value:string>>", (1, [("human", "h"), ("gpt", "g")]), [("user", "h"), ("assistant", "g")]),
    ],
)
def test_layouts_by_fingerprint(spark, shape, row, turns):
    got = chat.format_chat(spark.createDataFrame([row], shape)).select(chat.parse_chat(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in got.t] == turns


def test_unknown_layout_is_an_error(spark):
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


@pytest.mark.parametrize("name", ["edges", "small", "empty"])
def test_shards(name, request):
    docs = request.getfixturevalue(name)
    rows = sharding.shard_report(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    homes = {}
    assert all(homes.setdefault(r.doc_id, r.shard) == r.shard for r in rows)


def test_weights_are_met_and_movement_is_confined(spark):
    leaf = lambda s, w: sharding.Node(f"s{s}", w, (), s)
    tree = lambda w: sharding.inner("all", [sharding.inner("r0", [sharding.inner("k0", [leaf(0, 1.0), leaf(1, 3.0)]), sharding.inner("k1", [leaf(2, 2.0)])]), sharding.inner("r1", [sharding.inner("k2", [leaf(3, w), leaf(4, 1.0)])])])
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(sharding.assign_shards(ids, tree(1.0)), tree(2.0), column="then").collect()
    n = Counter(r.shard for r in rows)
    assert [round(8 * n[s] / 40_000, 1) for s in range(5)] == pytest.approx([1, 3, 2, 1, 1], abs=0.11)
    moved = [(r.shard, r.then) for r in rows if r.shard != r.then]
    assert moved and all(then in (3, 4) for _, then in moved)
