"""Removal of repeated byte strings by suffix sorting (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.bpe import GEAR
from joblog.llm.common import kept_table, sketch, sketched, small_batches
from joblog.llm.suffixes import Grouping

LENGTH = 200
# Bytes of a gram, a power of two: long enough that texts rarely share one by chance.
GRAM = 64
# Odd, fixed: multipliers of the rolling hash and of its last mixing.
MULTIPLIER, MIXER = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
# Bits of the sketch of shared anchors: 16 MiB at any size of the input.
SKETCH_BITS = 1 << 27
# Segment texts of one anchor that are suffix-sorted together; anchors with more are parted first.
SORTED_CLASSES = 2048
# Widths of the bands in which windows of such anchors are parted, in turn.
BANDS = (69, 23, 8, 2, 1)
# Bytes of segment texts that a task sorts at once.
SORTED_BYTES = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, built by doubling; mixed, so that the least is any."""
    h, width, power = GEAR[data], 1, MULTIPLIER
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & (1 << 64) - 1
    h = h * np.uint64(MIXER)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over each stretch of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the least hash of its grams; equal windows have equal anchors."""
    return _sliding(gram_hashes(data), LENGTH - GRAM + 1, np.minimum)


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, starts, ends, twice) of the runs of windows with one anchor; texts of at least ``LENGTH`` bytes.

    ``twice`` marks segments that may repeat one of their own windows: then
    their anchor's gram occurs twice inside them. Such grams are neighbours among
    the grams that are an anchor of some window.
    """
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    span = LENGTH - GRAM + 1
    least = _sliding(hashes, span, np.minimum)
    heads = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(heads[1:], len(least)) - 1 + LENGTH
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(hashes == _sliding(np.concatenate([edge, least, edge]), span, np.maximum))
    again = np.flatnonzero(hashes[at[1:]] == hashes[at[:-1]])
    first, second = at[again], at[again + 1]
    pair = np.searchsorted(first, heads)
    twice = np.zeros(len(heads), bool)
    found = pair < len(first)
    twice[found] = second[pair[found]] <= ends[found] - GRAM
    return least[heads].view(np.int64), heads, ends, twice


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.encode() if x else b"" for x in column.to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, d, c): rows of one text share the 128 bits d and c, and all that is found out about it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"d": F.xxhash64("text"), "c": F.xxhash64(F.lit(LENGTH), "text")})


def anchor_counts(docs: DataFrame) -> DataFrame:
    """Rows (anchor, n) of anchors with two segments or more, or one that may repeat a window of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(data) for data in _bytes(batch.column("text"))]
            own = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
            n = np.concatenate([1 + f[3].astype(np.int64) for f in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["anchor", "n"])

    counted = docs.filter(F.octet_length("text") >= LENGTH).select("text").mapInArrow(run, "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")


def shared_segments(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (anchor, hash, d, c, s, e, twice) of the segments whose anchor is in ``shared (anchor)``.

    A sketch of fixed size keeps most other segments from being shuffled; the
    join decides.
    """
    held = docs.sparkSession.sparkContext.broadcast(sketch(shared.select(F.col("anchor").alias("k1")), SKETCH_BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts, codes = [], [], []
            for i, data in enumerate(_bytes(batch.column("text"))):
                own = segments(data)
                some = sketched(held.value, own[0])
                own = tuple(x[some] for x in own)
                parts.append(own)
                row.append(np.full(len(own[0]), i))
                codes += [xxhash.xxh64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(own[1].tolist(), own[2].tolist(), strict=True)]
            if not parts:
                continue
            anchor, s, e, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(codes, pa.int64()), batch.column("d").take(at), batch.column("c").take(at),
                    pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(twice),
                ],
                ["anchor", "hash", "d", "c", "s", "e", "twice"],
            )

    rows = docs.filter(F.octet_length("text") >= LENGTH).mapInArrow(run, "anchor long, hash long, d long, c long, s int, e int, twice boolean")
    return rows.join(shared, "anchor")


def equal_windows(text: np.ndarray, order: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Whether the window at a position equals that at a neighbour in suffix order; compared byte by byte, eight at a time."""
    found = np.zeros(len(text), bool)
    a, b = order[:-1], order[1:]
    live = valid[a] & valid[b]
    a, b = a[live], b[live]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(0, LENGTH, 8):
        if not len(a):
            break
        same = (words[a + k] == words[b + k]).all(axis=1)
        a, b = a[same], b[same]
    found[a] = found[b] = True
    return found


def repeated_starts(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    """For each text of each group the starts of the windows that occur again in the group, by one suffix array a group."""
    parts, starts, spots, n = [], [], [], 0
    for texts in groups:
        starts.append(n)
        parts.append(np.zeros(1, np.int16))
        n += 1
        for t in texts:
            spots.append((n, len(t)))
            parts += [np.frombuffer(t, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
            n += len(t) + 1
    text = np.concatenate(parts)
    order = Grouping(text, np.array(starts)).suffix_array()
    valid = np.zeros(n, bool)
    for at, size in spots:
        valid[at : at + max(0, size - LENGTH + 1)] = True
    found = equal_windows(np.where(text > 0, text - 1, 0), order, valid)
    flat = iter(np.flatnonzero(found[at : at + size]) for at, size in spots)
    return [[next(flat) for _ in texts] for texts in groups]


def runs(starts: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Maximal intervals (from, to) covered by the windows at ``starts``, moved by ``base``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    low, high = np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])
    return [(int(a) + base, int(b) + base + LENGTH) for a, b in zip(low, high, strict=True)]


SPANS = "d long, c long, s int, e int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["d", "c", "s", "e"])


def sorted_spans(cut: DataFrame) -> DataFrame:
    """Spans found by suffix-sorting the segment texts of each anchor; many anchors go through one batched grouping."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(groups: list[list[tuple]]) -> pa.RecordBatch:
            out = []
            for rows, starts in zip(groups, repeated_starts([[r[5] for r in g] for g in groups]), strict=True):
                for r, found in zip(rows, starts, strict=True):
                    if r[1]:
                        out += [(r[2], r[3], a, b) for a, b in runs(found, r[4])]
            return _spans(out)

        groups: list[list[tuple]] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "target", "d", "c", "s", "bytes")), strict=True):
                if not groups or groups[-1][0][0] != row[0]:
                    if held > SORTED_BYTES:
                        yield solve(groups)
                        groups, held = [], 0
                    groups.append([])
                groups[-1].append(row)
                held += len(row[5])
        if groups:
            yield solve(groups)

    rows = cut.repartition("anchor").sortWithinPartitions("anchor")
    return rows.select("anchor", "target", "d", "c", "s", "bytes").mapInArrow(run, SPANS)


def _wide_hash(data: bytes) -> tuple[int, int]:
    w = xxhash.xxh3_128_intdigest(data)
    return (w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63)


def bands(data: bytes, gram: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of a segment's windows, parted by where their first ``gram`` hash lies, ``width`` places a band.

    Equal windows hold their first anchor gram at the same place. Those of a
    band share its core, the bytes that all of them hold around the gram, and
    the key is a hash of it: so equal windows of any two segments are in bands
    of one key, and a band of width 1 is a window.
    """
    places = np.flatnonzero(gram_hashes(np.frombuffer(data, np.uint8)).view(np.int64) == gram).tolist()
    windows, low = len(data) - LENGTH + 1, 0
    for p in places:
        start = low
        while start <= min(p, windows - 1):
            near = (p - start) // width * width  # the least distance from window to gram in this band
            far = min(near + width - 1, LENGTH - GRAM)
            stop = min(p - near, windows - 1)
            core = data[p - near : p + LENGTH - far]
            yield xxhash.xxh64_intdigest(core, near << 8 | width) - (1 << 63), start, stop + LENGTH
            start = stop + 1
        low = p + 1


def banded_spans(cut: DataFrame) -> DataFrame:
    """The same for anchors with many segment texts: parted by ``bands`` until the suffix grouping takes them.

    A band that occurs again as a whole repeats as a whole, and counts of equal
    bands combine before they are shuffled. A band alone with its key repeats
    nowhere. Bands of one key that differ go to the suffix grouping, or where
    they are too many to narrower bands; the narrowest are windows, of which
    those of one key are equal.
    """
    names = ["anchor", "target", "d", "c", "s", "bytes"]
    found = None
    left = cut.select(*names)
    for width in BANDS:

        def lay(batches: Iterable[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for anchor, target, d, c, s, data in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                    rows += [(k, *_wide_hash(data[a:b]), anchor, target, d, c, s + a, data[a:b]) for k, a, b in bands(data, anchor, width)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
                types = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], ["key", "h1", "h2", *names])

        laid = kept_table(left.mapInArrow(lay, "key long, h1 long, h2 long, anchor long, target boolean, d long, c long, s int, bytes binary"), "bands")
        same = ["key", "h1", "h2"]
        tally = kept_table(laid.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("d", "c", "s", "anchor", "target", "bytes")).alias("one")), "band-texts")
        whole = laid.filter("target").join(tally.filter("n > 1").select(*same), same).select("d", "c", "s", (F.col("s") + F.octet_length("bytes")).alias("e"))
        found = whole if found is None else found.unionByName(whole)
        asked = tally.groupBy("key").agg(F.count("*").alias("texts"), F.max((F.col("n") == 1) & F.col("one.target")).alias("open")).filter("open and texts > 1")
        one = tally.join(asked.select("key", "texts"), "key").select("key", "texts", (F.col("one.target") & (F.col("n") == 1)).alias("target"), "one.anchor", "one.d", "one.c", "one.s", "one.bytes")
        one = kept_table(one, "open-bands")
        few = F.col("texts") <= SORTED_CLASSES
        found = found.unionByName(sorted_spans(one.filter(few).withColumn("anchor", F.col("key"))))
        left = one.filter(~few).select(*names)
        if left.isEmpty():
            break
    return found


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (d, c, s, e), overlapping, that cover just the bytes of windows that occur again; ``docs`` as of ``keyed``.

    Windows of ``LENGTH`` bytes meet by their least gram hash, the anchor; runs
    of windows with one anchor are segments. Anchors that occur once end here.
    Segments that are equal as a whole repeat as a whole. What remains, a
    segment that differs from all others of its anchor, is compared with one
    text of each by a suffix array; anchors with over ``SORTED_CLASSES`` texts
    are parted first.
    """
    counts = kept_table(anchor_counts(docs), "anchors")
    met = kept_table(shared_segments(docs.select("d", "c", "text"), counts.select("anchor")), "segments")
    place = F.struct("d", "c", "s", "e")
    classes = kept_table(met.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max("twice").alias("twice")), "classes")
    whole = met.join(classes.filter("n > 1").select("anchor", "hash"), ["anchor", "hash"]).select("d", "c", "s", "e")
    tally = classes.groupBy("anchor").agg(F.count("*").alias("texts"), F.max((F.col("n") == 1) & ((F.col("twice")))).alias("own"), F.min("n").alias("least"))
    tally = tally.filter("least = 1 and (texts > 1 or own)").select("anchor", "texts")
    wanted = classes.join(tally, "anchor").select("anchor", "texts", (F.col("n") == 1).alias("target"), "at.*")
    wanted = kept_table(wanted, "wanted")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, c, text, asked in zip(*(batch.column(n).to_pylist() for n in ("d", "c", "text", "asked")), strict=True):
                data = text.encode()
                rows += [(x["anchor"], x["texts"], x["target"], d, c, x["s"], data[x["s"] : x["e"]]) for x in asked]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], ["anchor", "texts", "target", "d", "c", "s", "bytes"])

    def pieces(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("d", "c").agg(F.collect_list(F.struct("anchor", "texts", "target", "s", "e")).alias("asked"))
        # Rows of one text ask for the same bytes; one of them answers.
        answering = docs.join(asked, ["d", "c"]).dropDuplicates(["d", "c"]).select("d", "c", "text", "asked")
        return answering.mapInArrow(cut, "anchor long, texts long, target boolean, d long, c long, s int, bytes binary")

    few = F.col("texts") <= SORTED_CLASSES
    return whole.unionByName(sorted_spans(pieces(wanted.filter(few)))).unionByName(banded_spans(pieces(wanted.filter(~few))))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes).

    A byte goes if some ``LENGTH``-byte string that covers it also starts
    anywhere else in the input, the same document included; matches never cross
    documents, overlaps count, and strings are judged on the input alone. Null
    texts are empty; shorter texts stay whole; repeated rows are documents of
    their own, so theirs is all repeated; a null doc_id is an id; other columns
    are not read; an empty table stays empty. Ids must be integers.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    spans = repeated_spans(rows).groupBy("d", "c").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for x in spans or []:
                    edge[x["s"]] += 1
                    edge[x["e"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                heads = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), heads, data[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, ["d", "c"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
