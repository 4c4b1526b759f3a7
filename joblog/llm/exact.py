"""Exact dedup by an extendible-hash index on shared files (operator 12); DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import broadcast_checked, kept_table
from joblog.plans.ordered import pick_per

# Keys a bucket holds before it is split.
CAPACITY = 1 << 14
# Directory levels that are counted below the one that even keys would need.
SPARE_LEVELS = 4
# Bits of the sketch of keys that occur more than once: 8 MiB at any size of the input.
SKETCH_BITS = 1 << 26


def normalised(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, lower-cased; empty for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def key(text: Column, key_bits: int = 64) -> Column:
    """The leading ``key_bits`` bits of a 64-bit hash; fewer make keys collide."""
    return F.xxhash64(text).bitwiseAND(F.lit(-1 << (64 - key_bits)))


def _prefix(h: Column, bits: int) -> Column:
    """The leading ``bits`` bits of ``h`` as a number from 0; a shift by 64 would be none."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 1), 63 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, bucket) rows and the global depth: cells are the leading bits of keys ``(h)``, as many as the depth.

    One bucket holds all keys at first. A bucket with more than ``capacity``
    keys is split by the next bit, and the directory doubles with the first
    split of its level. A bucket is named by its bits behind a leading one. Keys
    of a level that all share their bits, so that no split parts them, stay in
    a bucket that is larger.
    """
    total = keys.count()
    deepest = min(40, max(0, (-(-total // capacity) - 1).bit_length()) + SPARE_LEVELS)
    cells = keys.groupBy(_prefix(F.col("h"), deepest).alias("fine")).agg(F.count("*").alias("n"))
    levels = cells.select("fine", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
    name = F.call_function("shiftright", F.col("fine") + F.lit(1 << deepest), (F.lit(deepest) - F.col("level")).cast("int"))
    levels = levels.withColumn("bucket", name)
    full = levels.groupBy("level", "bucket").agg(F.sum("n").alias("n"))
    settled = kept_table(full.filter((F.col("n") <= capacity) | (F.col("level") == deepest)).select("level", "bucket"), "buckets")
    # Every bucket below a settled one fits as well; the first on the way down counts.
    first = levels.join(settled, ["level", "bucket"]).groupBy("fine").agg(F.min(F.struct("level", "bucket")).alias("at"))
    first = kept_table(first.select("fine", "at.*"), "directory")
    depth = first.agg(F.max("level")).first()[0] or 0
    pointers = first.select(F.shiftright("fine", deepest - depth).alias("cell"), "bucket").distinct()
    return pointers, depth


def repeated_sketch(keys: DataFrame) -> DataFrame:
    """Rows (block, bitmap), ``SKETCH_BITS`` bits in all, of the keys (h, n) that occur more than once."""
    place = _place()
    return keys.filter("n > 1").groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def _place() -> Column:
    return F.col("h").bitwiseAND(F.lit(SKETCH_BITS - 1)) + 1


def _maybe_repeated(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """``rows (h, ...)`` with ``again``: false only where the key occurs once."""
    place = F.bitmap_bit_position(_place())
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.call_function("div", place, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined = rows.withColumn("block", F.bitmap_bucket_number(_place())).join(F.broadcast(sketch), "block", "left")
    return joined.withColumn("again", F.coalesce(found, F.lit(False))).drop("block", "bitmap")


def index_files(docs: DataFrame, keys: DataFrame, sketch: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """The index: (bucket, h, link, text_sha256, group_size, keep_id) of every text whose key occurs more than once.

    Copies of a text meet byte by byte in a grouping by key and text, which
    combines inside each task before texts move. The texts that are left go to
    the owner of their bucket, a range of keys, which chains different texts of
    one key in order: ``link`` is 0 for the first. Written to the shared folder.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    rows = rows.withColumn("h", key(F.col("t"), key_bits))
    some = _maybe_repeated(rows, sketch).filter("again")
    texts = some.groupBy("h", "t").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    pointers, depth = directory(keys, capacity)
    placed = texts.withColumn("cell", _prefix(F.col("h"), depth)).join(broadcast_checked(pointers), "cell")
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "h", "t")
    files = owned.select("bucket", "h", F.sha2("t", 256).alias("text_sha256"), "group_size", "keep_id", F.monotonically_increasing_id().alias("at"))
    files = kept_table(files, "exact-index")
    # The rows of a key lie in one task's file, in the order of their texts.
    first = files.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("links"))
    return files.join(first, "h").select("bucket", "h", (F.col("at") - F.col("first")).alias("link"), "links", "text_sha256", "group_size", "keep_id")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, bucket, link.

    Texts are equal if they are the same bytes after lower-casing A-Z; a null
    text is empty. Of equal texts the row with the largest ``doc_id`` stays, a
    null id being the smallest; of rows that repeat that id one stays.
    ``bucket`` and ``link`` are where the index holds the text, null for a text
    whose key occurs once. Texts of any length are compared whole; an empty
    table stays empty; other columns are not read.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    slim = rows.select("doc_id", key(F.col("t"), key_bits).alias("h"), F.sha2("t", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    slim = kept_table(slim, "exact-rows")  # numbers of rows are fixed from here on
    keys = kept_table(slim.groupBy("h").agg(F.count("*").alias("n")), "exact-keys")
    sketch = kept_table(repeated_sketch(keys), "exact-sketch")
    index = broadcast_checked(index_files(docs, keys, sketch, capacity, key_bits))
    marked = _maybe_repeated(slim, sketch)
    alone = marked.filter(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256",
        F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("link"),
    )
    # Rows of one key and digest are rows of one text: the index has compared their bytes.
    met = marked.filter("again").join(index, ["h", "text_sha256"])
    heads = met.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h", "text_sha256").agg(F.min("row").alias("stays"))
    told = met.join(broadcast_checked(heads), ["h", "text_sha256"])
    told = told.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "text_sha256", "bucket", "link")
    return alone.unionByName(told)


def without_copies(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``.

    Of rows that repeat the largest id of a text, any one stays, at most one
    of each task being shuffled.
    """
    groups = exact_groups(docs, capacity, key_bits)
    stay = groups.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    t = F.sha2(normalised(F.col("text")), 256)
    named = docs.withColumn("__own", t)
    met = named.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    return pick_per(met.withColumn("__row", F.monotonically_increasing_id()), ["doc_id", "__own"], ["__row"]).drop("__own", "__row")


def exact_report(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).drop("bucket", "link")
