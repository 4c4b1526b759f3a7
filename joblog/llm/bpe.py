"""BPE encoding and decoding with content-defined chunk reuse (operator 2)."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import small_batches

# A chunk ends where CUT_BITS bits of the rolling hash of the last WINDOW bytes are zero: every 512 bytes or so.
WINDOW, CUT_BITS, CUT_SHIFT = 16, 9, 24
# Bytes of chunks, and number of parts of words, that a worker remembers before it starts afresh.
CHUNK_MEMORY, PART_MEMORY = 4 << 20, 250_000
SPACE = b" \t\n\x0b\x0c\r"
# The vocabulary's own split of a lower-case Latin-1 word into parts that no token spans (fixed pattern).
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\x09-\\x0d\\x20\\x85\\xa0{LETTERS}{NUMBERS}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gear() -> np.ndarray:
    """256 well-mixed 64-bit values, by rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the ``WINDOW`` bytes that end there, built by doubling the window."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    return h


def cuts(h: np.ndarray) -> np.ndarray:
    """Ends of chunks in a text, from its rolling hashes; no cut where the window is not full."""
    ends = np.flatnonzero((h >> np.uint64(CUT_SHIFT)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    return ends[ends >= WINDOW]


def signature(h: np.ndarray) -> int:
    """The least mixed hash at the cuts: equal for texts that share their least-hashed chunk end."""
    ends = cuts(h)
    found = h[ends - 1] if len(ends) else h[-1:]
    return int((found * np.uint64(0x9E3779B97F4A7C15)).min().view(np.int64)) if len(found) else 0


def joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    found = [x for x in found if x[0]]
    return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


class Encoder:
    """Encodes and decodes texts exactly as the library does, each distinct chunk once.

    No token spans white space, so a chunk is exact between its first and last
    space; the pieces of words at a join are put together, over as many chunks
    as the word spans, and encoded again. Parts of words go to the library once
    each. What is remembered is bounded and starts afresh when full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[bytes, tuple[bytes, tuple[int, str, str], bytes] | None] = {}
        self.held = 0

    def part(self, piece: str) -> tuple[int, str, str]:
        """(number of ids, ids joined, tokens joined) of text without a space, by the library."""
        found = self.parts.get(piece)
        if found is None:
            if len(self.parts) >= PART_MEMORY:
                self.parts.clear()
            got = self.tokenizer.encode(piece, add_special_tokens=False)
            found = len(got.ids), " ".join(map(str, got.ids)), self.tokenizer.decode(got.ids, skip_special_tokens=False)
            if len(piece) <= 64:
                self.parts[piece] = found
        return found

    def run(self, data: bytes) -> tuple[int, str, str]:
        """The same for whole words. Where the library would split in any case, the parts are encoded on their own.

        That holds for Latin-1: its characters don't compose, and lose their
        case alike before or after the split. Other words, and such with ``<|``,
        which may hold a special token, stay whole.
        """
        try:
            if b"<|" in data:
                raise ValueError
            text = data.decode()
            text.encode("latin-1")
            parts = PARTS.findall(text.lower())
        except ValueError:
            words = [w.decode() for w in data.split()]
            parts = []
            for w in words:
                parts += PARTS.findall(w.lower()) if "<|" not in w and max(w) <= "\xff" else [w]
        known, part = self.parts.get, self.part
        return joined([known(p) or part(p) for p in parts])

    def chunk(self, data: bytes) -> tuple[bytes, tuple[int, str, str], bytes] | None:
        """(bytes before the first space, what lies between, bytes after the last space); None without a space."""
        if data in self.chunks:
            return self.chunks[data]
        head, rest = b"", data
        if data[0] not in SPACE:
            head, *more = data.split(None, 1)
            rest = more[0] if more else b""
        if len(head) == len(data):
            made = None
        else:
            tail = b""
            if rest and rest[-1] not in SPACE:
                *more, tail = rest.rsplit(None, 1)
                rest = more[0] if more else b""
            made = head, self.run(rest), tail
        self.held += len(data)
        if self.held > CHUNK_MEMORY:
            self.chunks.clear()
            self.held = len(data)
        self.chunks[data] = made
        return made

    def encode(self, data: bytes, ends: np.ndarray) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text) of a text with the given chunk ends."""
        out, open_word, start = [], b"", 0
        for end in [*ends.tolist(), len(data)]:
            if end == start:
                continue
            made = self.chunk(data[start:end])
            if made is None:
                open_word += data[start:end]
            else:
                head, middle, tail = made
                if open_word or head:
                    out.append(self.run(open_word + head))
                out.append(middle)
                open_word = tail
            start = end
        if open_word:
            out.append(self.run(open_word))
        return joined(out)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def _buffers(column: pa.Array) -> list[bytes]:
    return [x.encode() if x else b"" for x in column.to_pylist()]


def gathered(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` dealt so that texts which share chunks tend to meet in a task.

    A rebalance by the least hash at the chunk ends: adaptive execution splits
    what is too large, so a group of copies of any size is no hot key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [signature(rolling(np.frombuffer(b, np.uint8))) if b else i for i, b in enumerate(_buffers(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "text", "near"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, near long").hint("rebalance", "near")


def encode_documents(docs: DataFrame, vocabulary: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids and the decoded text.

    Chunks end where a rolling hash says so, hence texts with a common passage
    have common chunks; a task encodes each distinct chunk once, and texts are
    dealt to tasks so that sharing ones meet. Joins are repaired by encoding
    the words across them again. Equal to the library on the whole text: white
    space ends a token, and normalisation does not reach across it. Null and
    empty texts have no token; texts are read whole; repeated rows come out as
    often; other columns are not read; an empty table stays empty.
    ``vocabulary`` is the path of a tokenizers file on every worker.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = encoder_of(vocabulary)
            rows = []
            for data in _buffers(batch.column("text")):
                rows.append(encoder.encode(data, cuts(rolling(np.frombuffer(data, np.uint8)))))
            columns = [
                batch.column("doc_id"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return gathered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "text").mapInArrow(run, shape)


def bpe_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return encode_documents(docs, vocabulary or default_vocabulary(), ids=False)
