"""Hierarchical weighted hash tree (operator 10), DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a shard are numbered in this many hash buckets at once.
BUCKETS = 256


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``name`` enters the draws; a leaf has its shard number."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def inner(name: str, children: Sequence[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def shard_tree(shards: int, planned: int | None = None, racks: int = 2, per_rack: int = 4) -> Node:
    """Equal shards 0 .. ``shards - 1``: the ``planned`` ones in regions of racks, each later one in a region of its own.

    Growth beyond the plan only adds regions, so it takes rows only into the
    new shard. Re-planning is a new layout, chosen by the operator's user.
    """
    planned = shards if planned is None else min(planned, shards)
    leaf = lambda s: Node(f"shard-{s}", 1.0, (), s)
    leaves = [leaf(s) for s in range(planned)]
    rows = [inner(f"rack-{i}", leaves[i * per_rack : (i + 1) * per_rack]) for i in range((planned + per_rack - 1) // per_rack)]
    regions = [inner(f"region-{i}", rows[i * racks : (i + 1) * racks]) for i in range((len(rows) + racks - 1) // racks)]
    grown = [inner(f"region-own-{s}", [inner(f"rack-own-{s}", [leaf(s)])]) for s in range(planned, shards)]
    return inner("all", regions + grown)


def place(tree: Node, *key: str) -> Column:
    """The shard of a row: at each level the child with the least exponential draw ``-ln(u) / weight``.

    A draw depends on the key and the child's name alone. If one child's weight
    changes, the other children's draws stay, so rows move only into it (heavier
    or new) or out of it (lighter): movement stays in subtrees whose weights
    change.
    """
    if tree.shard is not None:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(tree.children[0], *key)

    def draw(child: Node) -> Column:
        bits = F.xxhash64(*key, F.lit(child.name)).bitwiseAND(F.lit((1 << 52) - 1))
        return -F.ln((bits + 0.5) / float(1 << 52)) / child.weight

    draws = F.array(*(F.struct(draw(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(tree.children)))
    if all(c.shard is not None for c in tree.children):
        shards = F.array(*(F.lit(c.shard) for c in tree.children))
        return F.get(shards, F.array_min(draws)["i"])
    below = F.array(*(F.lit(i) for i in range(len(tree.children))))
    chosen = F.get(below, F.array_min(draws)["i"])

    def descend(i: Column) -> Column:
        branch = F.when(i == 0, place(tree.children[0], *key))
        for k, child in enumerate(tree.children[1:], 1):
            branch = branch.when(i == k, place(child, *key))
        return branch

    return F.get(F.transform(F.array(chosen), descend), F.lit(0))


def assign_shards(docs: DataFrame, tree: Node, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """``docs`` with their shard; no shuffle. Rows of one key go together, null is a key too; a clashing column is replaced."""
    return docs.withColumn(column, place(tree, key).cast("int"))


def numbered(rows: DataFrame, keys: DataFrame, within: str = "shard", key: str = "doc_id", ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each ``within``, by hash bucket, then ``key`` and ``ties``.

    ``keys (within, key)`` is the same rows, cheap to read. Buckets are counted
    first; their offsets, at most shards x ``BUCKETS`` rows, are broadcast. So
    no task sorts a whole shard. Rows of one key share a bucket.
    """
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(BUCKETS)).cast("int")
    counts = keys.groupBy(within, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(within, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    order = Window.partitionBy(within, "_bucket").orderBy(key, *ties)
    ranked = rows.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(order))
    joined = ranked.join(F.broadcast(offsets), [within, "_bucket"])
    return joined.withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_offset")


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Law ``key``: doc_id and shard count decide. A null text has no bytes: size 16, checksum 0."""
    now, then = shard_tree(shards, shards), shard_tree(shards + 1, shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, now), then, column="grown_shard").withColumn("law", F.lit("key"))
    keys = assign_shards(docs.select("doc_id"), now)
    return numbered(rows, keys, ties=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
