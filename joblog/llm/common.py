"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblog.session import ensure_checkpoint_dir, scratch_path

# The white space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The maximal runs of other characters than white space; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.filter(parts, lambda w: w != "")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# Rows of a registry-like side, such as one row per source, that may be broadcast.
BROADCAST_ROWS = 50_000


def broadcast_checked(df: DataFrame) -> DataFrame:
    """``df``, stored, and marked for broadcast if it has at most ``BROADCAST_ROWS`` rows.

    Beyond that the join is shuffled, and a hot key is left to the adaptive skew join.
    """
    df = stored(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)`` as rows ``(node, root)``; root is the least node.

    Alternating large and small stars: each round points every node at the
    least node it knows of, until the edges form stars. Minima are combined
    before they are shuffled, so a node of any degree is no hot key; the joins
    that follow are plain and left to the adaptive skew join. Every round is
    checkpointed. Nodes without an edge are not returned.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").distinct()

    now = stored(tidy(edges.select("a", "b")))
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = stored(tidy(small(tidy(large(now)))))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers in batches of at most ``rows``, so that long ones don't add up."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is made and run in here deletes its shuffle files when it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame, path: str, parts: tuple[str, ...] = (), **options: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read from there: compressed, unlike a checkpoint."""
    return _written(df, scratch_path(df.sparkSession, name))


# Keeps a table as ``kept_table`` does, with the columns that part it in folders and the writer's options.
Keep = Callable[..., DataFrame]


@contextmanager
def brief_tables(spark: SparkSession) -> Iterator[Keep]:
    """A ``kept_table`` whose tables are deleted when this ends, so that only what a later step still reads takes disk."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str, *parts: str, **options: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        return _written(df, paths[-1], parts, **options)

    try:
        yield keep
    finally:
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# Bits of a sketch that are put together in one row, and places a task gathers before it hands them on.
SKETCH_BLOCK, GATHERED = 1 << 15, 1 << 20
# Blocks of a sketch that come to the driver at a time: 8 MiB.
BLOCKS_AT_ONCE = 1 << 11


def _probed(keys: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """The ``probes`` places of each of ``keys`` in a filter."""
    a, b = keys & (bits - 1), (keys >> 32) & 0xFFFFFFFF & (bits - 1)
    return [a, b, *((a + i * b) & (bits - 1) for i in range(1, probes - 1))]


def sketch(keys: DataFrame, bits: int, probes: int = 2) -> np.ndarray:
    """A Bloom filter of ``keys (k1)``, 64-bit hashes, in ``bits`` bits, ``probes`` a key, however many keys there are.

    Tasks send two bytes for each bit they set, sorted by block; blocks are put
    together where they are shuffled to, and come to the driver as they are, in
    all ``bits`` / 8 bytes. Many keys fill it, and then it lets more pass; it
    never holds a key back.
    """
    return sketches(keys.select("k1"), bits, probes, layers=(0,))[0]


def _keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("k1").to_numpy()


def sketches(
    rows: DataFrame,
    bits: int,
    probes: int = 2,
    twice_bits: int | None = None,
    keys: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]] = _keys_of,
    layers: tuple[int, ...] = (0, 1),
) -> tuple[np.ndarray, np.ndarray]:
    """The filter of all keys, and one that never holds back a key that is there twice.

    ``keys`` draws them from a task's ``rows``. The second filter may have fewer
    bits, ``twice_bits``: blocks that are one in it meet in one task, so no more
    of them comes to the driver. A filter of over ``BLOCKS_AT_ONCE`` blocks is
    stored first and comes in parts, so the driver holds it only once. One that
    is not in ``layers`` does not come, and stays empty.
    """
    block = min(bits, SKETCH_BLOCK)
    folds = max(min(twice_bits or bits, bits) // block, 1)

    def spread(found: list[np.ndarray]) -> pa.RecordBatch:
        places, times = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
        places = np.repeat(places, np.minimum(times, 2))
        heads = np.flatnonzero(np.diff(places // block, prepend=-1))
        parts = np.split((places % block).astype("<u2"), heads[1:]) if len(heads) else []
        return pa.RecordBatch.from_arrays([pa.array((places[heads] // block).astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "places"])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for own in keys(batches):
            found += _probed(own, bits, probes)
            held += probes * len(own)
            if held >= GATHERED:
                yield spread(found)
                found, held = [], 0
        yield spread(found)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(layer: int, number: int, marks: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([layer], pa.int32()), pa.array([number], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["layer", "block", "marks"])

        number, own, once, twice = None, np.zeros(block, bool), np.zeros(block, bool), np.zeros(block, bool)

        def done(following: int | None) -> Iterator[pa.RecordBatch]:
            """Block ``number``, and the folded one if ``following`` is of another."""
            yield packed(0, number, own)
            own[:] = False
            if following is None or following % folds != number % folds:
                yield packed(1, number % folds, twice)
                once[:] = twice[:] = False

        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("places").to_pylist(), strict=True):
                if at != number and number is not None:
                    yield from done(at)
                number, places = at, np.frombuffer(data, "<u2")
                twice[places[once[places]]] = True
                twice[places[1:][places[1:] == places[:-1]]] = True
                own[places] = once[places] = True
        if number is not None:
            yield from done(None)

    marked = rows.mapInArrow(mark, "block int, places binary").withColumn("fold", F.pmod("block", F.lit(folds)))
    out = tuple(np.zeros(size if layer in layers else 0, np.int64) for layer, size in enumerate((bits // 64, folds * block // 64)))
    sorted_rows = marked.repartition("fold").sortWithinPartitions("fold", "block").select("block", "places")
    with shuffles_dropped(rows.sparkSession), brief_tables(rows.sparkSession) as keep:
        merged = sorted_rows.mapInArrow(merge, "layer int, block int, marks binary").filter(F.col("layer").isin(*layers))
        if bits // block <= BLOCKS_AT_ONCE:
            parts = [merged]
        else:
            merged = keep(merged, "sketch")
            parts = [merged.filter(f"block >= {low} and block < {low + BLOCKS_AT_ONCE}") for low in range(0, bits // block, BLOCKS_AT_ONCE)]
        for part in parts:
            for row in part.collect():
                found = np.frombuffer(row.marks, "<i8")
                out[row.layer][row.block * (block // 64) :][: len(found)] = found
    return out


def sketched(filled: np.ndarray, keys: np.ndarray, probes: int = 2) -> np.ndarray:
    """Whether each of ``keys`` (signed 64-bit) may be in the filter, made with as many ``probes``."""
    found = np.ones(len(keys), np.int64)
    for at in _probed(keys, 64 * len(filled), probes):
        found &= filled[at >> 6] >> (at & 63)
    return found.astype(bool)
