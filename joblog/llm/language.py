"""Language identification by inferring a mixture of languages (operator 1)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import small_batches

UNKNOWN = "und"
N = 3
BUCKETS = 1 << 16
SMOOTHING = 0.5
# Languages a model may have; its table is LANGUAGES x BUCKETS numbers at most.
LANGUAGES = 256
# Languages a task counts before it hands its counts on.
COUNTED = 64
ROUNDS, STILL = 40, 1e-4
LETTER = regex.compile(r"\p{L}")


def _plain() -> np.ndarray:
    """A-Z to a-z; other ASCII that is no letter to a space; bytes of other characters stay."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


PLAIN = _plain()


def grams(text: str) -> np.ndarray:
    """Hash buckets of the byte n-grams of the whole text, padded by a space at both ends."""
    data = PLAIN[np.frombuffer(b" " + text.encode() + b" ", np.uint8)].astype(np.uint64)
    if len(data) < N:
        return np.empty(0, np.int64)
    code = data[: len(data) - N + 1].copy()
    for i in range(1, N):
        code = code * np.uint64(256) + data[i : len(data) - N + 1 + i]
    code = code[code != np.uint64(0x202020)]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # languages x buckets


def fit(labelled: DataFrame) -> Model:
    """N-gram likelihoods of each language from all rows of ``labelled (text, lang)``; nulls teach nothing.

    Tasks count into one array per language and emit what is not zero; sums
    meet by (language, bucket). The model has ``LANGUAGES`` languages at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in counts:
                    if len(counts) >= COUNTED:
                        yield from rows()
                        counts.clear()
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                found, n = np.unique(grams(text), return_counts=True)
                counts[lang][found] += n
        yield from rows()

    labelled = labelled.select("text", "lang").filter("text is not null and lang is not null")
    sums = labelled.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(LANGUAGES * BUCKETS + 1).toPandas()
    names = tuple(sorted(found["lang"].unique()))
    if len(names) > LANGUAGES or len(found) > LANGUAGES * BUCKETS:
        raise ValueError(f"over {LANGUAGES} languages; raise LANGUAGES and check that the model fits a worker")
    table = np.full((len(names), BUCKETS), SMOOTHING)
    table[found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), found["bucket"].to_numpy(int)] += found["n"].to_numpy()
    return Model(names, (table / table.sum(axis=1, keepdims=True)) if len(names) else table)


def proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation maximisation: language shares and log likelihood, for likelihoods ``p`` (languages x n-grams) and counts ``n``."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(ROUNDS):
        moved = share * (p @ (n / (share @ p))) / total
        still = np.abs(moved - share).max() < STILL
        share = moved
        if still:
            break
    return share, float(n @ np.log(share @ p))


def mixture(p: np.ndarray, n: np.ndarray) -> list[tuple[int, float]]:
    """The languages of a text with their shares, largest first.

    Sets grow by descending share in the full mixture; one more language must
    raise the log likelihood by over half the log of the number of n-grams
    (Schwarz). What the full mixture gains bounds what any set can gain.
    """
    alone = np.log(p) @ n
    best = int(alone.argmax())
    chosen, shares, reached = [best], np.ones(1), float(alone[best])
    price = 0.5 * np.log(max(n.sum(), 2))
    if len(p) > 1:
        full, most = proportions(p, n)
        order = [best, *(int(i) for i in np.argsort(-full, kind="stable") if i != best)]
        for k in range(2, len(p) + 1):
            if most - reached <= price:
                break
            share, now = (full[order], most) if k == len(p) else proportions(p[order[:k]], n)
            if now - reached <= price:
                break
            chosen, shares, reached = order[:k], share, now
    return sorted(((c, float(s)) for c, s in zip(chosen, shares, strict=True)), key=lambda x: (-x[1], x[0]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score, shares): the main language, its share, and all languages found.

    Reads doc_id and text only. Null texts, texts without a letter, and all
    texts under a model without languages are ``und`` with score 0. Texts are
    read whole; ties go to the first language by name; repeated rows come out
    as often; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, likelihood = held.value.languages, held.value.likelihood
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found, n = (None, None) if not languages or not text or not LETTER.search(text) else np.unique(grams(text), return_counts=True)
                got = [] if found is None else mixture(likelihood[:, found], n.astype(float))
                out.append([(languages[i], s) for i, s in got])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0][0] if x else UNKNOWN for x in out], pa.string()),
                    pa.array([min(1.0, x[0][1]) if x else 0.0 for x in out], pa.float64()),
                    pa.array([[{"lang": a, "share": b} for a, b in x] for x in out], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_report(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
