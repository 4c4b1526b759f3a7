"""Mixing sources to target weights by block quotas (operator 4), DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblog.llm.common import broadcast_checked, let, stored, words

BLOCK_WORDS = 32
SHARD_WORDS = 1 << 16
# Shards that share one apportionment; groups of them are apportioned first.
FAN_OUT = 4096
# A prime above every number of blocks in a shard, so multiplying permutes the block numbers.
STRIDE = 2_654_435_761


def source_targets(totals: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``totals (source, source_size)`` with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; none gets over ``most`` times its size, the
    excess goes to the others by weight. With sources ordered by cap per
    weight, the common level is the largest of (what is left) / (weight left).
    One row per source meets in one task.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(listed) - 1) % len(weights) + 1))
    rows = totals.withColumn("weight", weigh.cast("double")).withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = F.max("level").over(everyone)
    return (
        rows.withColumn("level", left / F.sum("weight").over(onward))
        .withColumn("target", F.least("cap", level * F.col("weight")))
        .select("source", "source_size", "target")
    )


def sainte_lague(df: DataFrame, within: Sequence[str], weight: str, seats: Column, cap: Column, tie: Sequence[str]) -> DataFrame:
    """``df`` with ``quota``: ``seats`` of each group ``within`` go to its rows by the highest ``weight / (2k - 1)``.

    A divisor a little too large gives every row seats it has for certain, one
    a little too small the seats it may get; only those between, at most about
    two a row, are ranked. No row gets over ``cap``; equal quotients go by ``tie``.
    """
    group = Window.partitionBy(*within)
    total, n = F.sum(weight).over(group), F.count("*").over(group)
    framed = df.withColumns({"_seats": seats.cast("long"), "_cap": cap.cast("long"), "_w": F.col(weight).cast("double"), "_sum": total.cast("double"), "_n": n})
    share = F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum") * F.col("_seats")).otherwise(0.0)
    slack = F.when(F.col("_seats") > 0, F.col("_n") / (2 * F.col("_seats"))).otherwise(0.0)
    low = F.least("_cap", F.greatest(F.lit(0), F.ceil(share * (1 - slack) - 0.5)).cast("long"))
    high = F.when(F.col("_w") > 0, F.least("_cap", F.floor(share * (1 + slack) + 1.5).cast("long"))).otherwise(0)
    framed = framed.withColumn("_low", low).withColumn("_high", high)
    framed = framed.withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    open_seats = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>"))
    seats_of = framed.select("*", F.explode_outer(open_seats).alias("_k"))
    best = Window.partitionBy(*within).orderBy((F.col("_w") / (2 * F.col("_k") - 1)).desc_nulls_last(), *tie, "_k")
    ranked = seats_of.withColumn("_won", ((F.row_number().over(best) <= F.col("_left")) & F.col("_k").isNotNull()).cast("long"))
    return ranked.groupBy(*df.columns).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def mixture(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """Per document how much of it the mix takes: doc_id, size, source, source_size, target, taken, and ``spans``.

    Each source's documents, in seeded order, are dealt to shards of about
    ``SHARD_WORDS`` words; a shard's words in a row are cut into near-equal
    blocks of ``BLOCK_WORDS``. Sainte-Lague gives blocks to the sources, then to
    each source's groups of shards and shards; a shard takes every block
    ``quota div n`` times and a seeded choice of ``quota mod n`` once more. So a
    source misses its target by about half a block, and no document exceeds
    ``most`` (whole) times its size. ``spans`` has (from, to, times) in words;
    columns to ``carry`` along come last.

    Only (id, source, size) is shuffled, written once to the shared folder.
    Null texts have size 0 and take 0; a null source is a source of its own,
    last; repeated rows are documents of their own; a source without words has
    target 0; an empty table gives an empty result.
    """
    sized = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *carry))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most).withColumn("src", _key("source"))
    targets = targets.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))

    dealt = (
        sized.withColumn("src", _key("source"))
        .join(broadcast_checked(targets.select("src", "source_size", "target", "shards")), "src")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))
    )
    lot = Window.partitionBy("src", "shard")
    row = lot.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"end": F.sum("size").over(row), "lot": F.sum("size").over(lot)})

    lots = dealt.groupBy("src", "shard").agg(F.sum("size").alias("lot"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    lots = lots.filter("lot > 0").withColumn("blocks", _blocks(F.col("lot"))).withColumn("part", F.floor(F.col("shard") / FAN_OUT))
    parts = lots.groupBy("src", "part", "source_size", "target").agg(F.sum("blocks").alias("blocks"))
    sources = parts.groupBy("src", "source_size", "target").agg(F.sum("blocks").alias("blocks"))
    sources = sources.withColumn("wanted", F.col("target") / F.col("source_size") * F.col("blocks"))
    whole = int(most)
    top = sainte_lague(sources, [], "wanted", F.round(F.sum("wanted").over(Window.partitionBy())), whole * F.col("blocks"), ["src"])
    mid = parts.join(top.select("src", F.col("quota").alias("given")), "src")
    mid = sainte_lague(mid, ["src"], "blocks", F.col("given"), whole * F.col("blocks"), ["part"])
    leaf = lots.select("src", "part", "shard", "blocks").join(mid.select("src", "part", F.col("quota").alias("given")), ["src", "part"])
    leaf = sainte_lague(leaf, ["src", "part"], "blocks", F.col("given"), whole * F.col("blocks"), ["shard"])

    joined = placed.join(leaf.select("src", "shard", "blocks", "quota"), ["src", "shard"], "left")
    n, start, end = F.col("blocks"), F.col("end") - F.col("size"), F.col("end")
    holder = lambda word: F.call_function("div", (word + 1) * n - 1, F.col("lot"))
    edge = lambda k: F.call_function("div", F.col("lot") * k, n)
    shift = F.pmod(F.xxhash64("src", "shard", F.lit(seed + 2)), n)
    extra = lambda k: (F.pmod(F.lit(STRIDE) * k + shift, n) < F.col("quota") % n).cast("long")
    piece = lambda k: F.struct(
        (F.greatest(start, edge(k)) - start).alias("from"),
        (F.least(end, edge(k + 1)) - start).alias("to"),
        (F.call_function("div", F.col("quota"), n) + extra(k)).alias("times"),
    )
    spans = F.when((F.col("size") > 0) & n.isNotNull(), F.transform(F.sequence(holder(start), holder(end - 1)), piece))
    spans = F.coalesce(spans, F.array().cast("array<struct<from:bigint,to:bigint,times:bigint>>"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["to"] - s["from"]) * s["times"])
    return joined.withColumn("spans", spans).select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "spans", *carry)


def _blocks(lot: Column) -> Column:
    return F.greatest(F.lit(1), F.round(lot / BLOCK_WORDS)).cast("long")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time words of a document are taken.

    A document taken whole keeps its text; otherwise its taken words, in
    order, are joined by single spaces. Documents of which nothing is taken go.
    Repeated rows are taken as often as the mix says for all of them.
    """
    keyed = docs.withColumns({"_k1": F.xxhash64("doc_id", "text", "source"), "_k2": F.xxhash64("source", "text", "doc_id")})
    mix = mixture(keyed, seed=seed, carry=["_k1", "_k2"]).filter("taken > 0").groupBy("_k1", "_k2").agg(F.first("size").alias("_size"), F.collect_list("spans").alias("_copies"))
    each = keyed.join(mix, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).withColumn("_spans", F.explode("_copies"))
    most = F.array_max(F.transform("_spans", lambda s: s["times"]))
    each = each.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    here = F.filter("_spans", lambda s: s["times"] >= F.col("_pass"))
    each = each.withColumn("_here", here).withColumn("_n", F.aggregate("_here", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]))
    parts = lambda w: F.flatten(F.transform("_here", lambda s: F.slice(w, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    # Bound, so that the words are split once and not for each span.
    text = F.when(F.col("_n") == F.col("_size"), F.col("text")).otherwise(let(words(F.col("text")), lambda w: F.array_join(parts(w), " ")))
    each = each.withColumn("text", text)
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return each.select(*docs.columns)


def mixing_report(docs: DataFrame) -> DataFrame:
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")
