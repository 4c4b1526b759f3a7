"""Ordered per-key computations that no hot key can hold up.

A window partitioned by key puts all rows of a key into one task. That is fine
for ordinary keys. Hot keys - found by a count that is aggregated before it is
shuffled - are cut into chunks of their order (a range of sequence numbers or of
time), and each (key, chunk) is sorted in a task of its own. What a chunk has to
know about the chunks before it arrives as one *carry row* sorted in front of
it, computed from one summary row per chunk. This changes the plan, never the
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
CARRY = "__carry"
HOT = "__hot"

# A key with more rows than this is hot.
HOT_ROWS = 1_000_000
# At most so many keys are treated as hot, the largest first. Every other key
# then has at most HOT_ROWS rows or one in so many of all rows.
HOT_KEYS = 50_000
# Rows of one hot key in one chunk at most, when chunks are ranges of a unique sequence number.
SEQ_CHUNK = 1_000_000
# Width of one chunk, when chunks are ranges of time. Narrow on purpose: a hot
# key's year is then half a million summary rows, and its busiest minute one task.
TIME_CHUNK_SECONDS = 60


def floor_div(column: Column, width: int) -> Column:
    """Integer division rounding down, exact over the whole BIGINT range."""
    return F.call_function("div", column - F.pmod(column, F.lit(width)), F.lit(width))


def seq_chunk(column: str, rows: int = SEQ_CHUNK) -> Column:
    return floor_div(F.col(column).cast("bigint"), rows)


def time_chunk(column: str, seconds: int = TIME_CHUNK_SECONDS) -> Column:
    return floor_div(F.unix_micros(column), seconds * 1_000_000)


def _by(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def pick_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key.

    The ``row_number() = 1`` form lets Catalyst prune every task's rows to one
    per key before the shuffle, so a hot key moves one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*_by(order, last))
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The hot keys, at most HOT_KEYS of them, marked for broadcast."""
    top = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    return F.broadcast(
        top.orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias(HOT))
    )


def cut(rows: DataFrame, keys: Sequence[str], chunk: Column, hot: DataFrame, rest: Column | None = None) -> DataFrame:
    """Add CHUNK (``rest``, else 0, for ordinary keys) and HOT (null for ordinary keys); keys are not null."""
    marked = rows.join(hot, list(keys), "left").select(*rows.columns, HOT)
    return marked.withColumn(CHUNK, F.when(F.col(HOT), chunk).otherwise(F.lit(0) if rest is None else rest))


def stack(keyed: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows and carry rows, told apart by CARRY; columns one side lacks are null."""
    return (
        keyed.drop(HOT)
        .withColumn(CARRY, F.lit(False))
        .unionByName(carried.withColumn(CARRY, F.lit(True)), allowMissingColumns=True)
    )


def previous_row(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[str],
    prefix: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the ``values`` of the row just before each row of its key."""
    keyed = cut(rows, keys, chunk, hot_keys(rows, keys, hot_rows))
    # The last row of each chunk is what the chunk after it has to see.
    edge = pick_per(keyed.filter(HOT), [*keys, CHUNK], order).select(*keys, CHUNK, *values)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = edge.select(*keys, CHUNK, *[F.lag(v).over(across).alias(v) for v in values])
    within = Window.partitionBy(*keys, CHUNK).orderBy(F.col(CARRY).desc(), *_by(order, False))
    return (
        stack(keyed, carried)
        .select("*", *[F.lag(v).over(within).alias(prefix + v) for v in values])
        .filter(~F.col(CARRY))
        .drop(CHUNK, CARRY)
    )


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    name: str,
    restart_after: str | None = None,
    hot_rows: int = HOT_ROWS,
    rest: Column | None = None,
) -> DataFrame:
    """Number the rows of each key from 1; start again after a ``restart_after`` row.

    ``chunk`` rises with ``order``; unless it is a number, ``rest`` is a value of its type.
    """
    keyed = cut(rows, keys, chunk, hot_keys(rows, keys, hot_rows), rest)
    hot = keyed.filter(HOT)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    if restart_after is None:
        counts = hot.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried = counts.select(*keys, CHUNK, F.sum("__n").over(before).alias("__weight"))
    else:
        # Rows of the chunk that follow its last restart, and whether it has one.
        # Backwards, so that the frame only grows; a shrinking one is summed anew for each row.
        backwards = Window.partitionBy(*keys, CHUNK).orderBy(*_by(order, True))
        ahead = backwards.rowsBetween(Window.unboundedPreceding, 0)
        tails = (
            hot.select(*keys, CHUNK, *order, F.col(restart_after).cast("int").alias("__restart"))
            .withColumn("__ahead", F.sum("__restart").over(ahead))
            .groupBy(*keys, CHUNK)
            .agg(F.count_if(F.col("__ahead") == 0).alias("__n"), F.max("__restart").alias("__has"))
            .withColumn("__run", F.sum("__has").over(across))
        )
        in_run = Window.partitionBy(*keys, "__run").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
        carried = tails.withColumn("__exit", F.sum("__n").over(in_run)).select(
            *keys, CHUNK, F.lag("__exit").over(across).alias("__weight")
        )
    stacked = stack(keyed.withColumn("__weight", F.lit(1).cast("bigint")), carried.filter("__weight > 0"))
    ordered = Window.partitionBy(*keys, CHUNK).orderBy(F.col(CARRY).desc(), *_by(order, False))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__weight").over(so_far)
    if restart_after is not None:
        # Rows up to the last restart before this row are not counted.
        stacked = stacked.withColumns({"__total": total, "__ends": F.col(restart_after)})
        upto = F.max(F.when(F.col("__ends"), F.col("__total"))).over(
            ordered.rowsBetween(Window.unboundedPreceding, -1)
        )
        total = F.col("__total") - F.coalesce(upto, F.lit(0))
    return (
        stacked.withColumn(name, total)
        .filter(~F.col(CARRY))
        .drop(CHUNK, CARRY, "__weight", "__total", "__ends")
    )
