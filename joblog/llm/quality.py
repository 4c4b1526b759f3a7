"""Quality rules as a short-circuit cascade (operator 3), DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblog.llm.common import SPACES, let, without, words

SYMBOLS = "#*$%&|<>"
# Documents, whole, on which cost and selectivity are estimated.
SAMPLE_DOCS = 400


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_chars(column: str = "text") -> Column:
    return F.length(without(_text(column), SPACES)).cast("long")


def n_symbols(column: str = "text") -> Column:
    return (F.length(_text(column)) - F.length(without(_text(column), SYMBOLS))).cast("long")


def _worded_lines(column: str) -> Column:
    return F.filter(F.split(_text(column), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_lines(column: str = "text") -> Column:
    return F.size(_worded_lines(column)).cast("long")


def n_dup_lines(column: str = "text") -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_worded_lines(column), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_words(column: str = "text") -> Column:
    return F.size(words(F.col(column))).cast("long")


def repeated_words(w: Column) -> Column:
    """How many words of the array ``w`` lie in a 3-word window that occurs twice or more.

    Windows are told apart by 64-bit hashes, sorted once: n log n for n words.
    """

    def windows(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(a) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"))
        return F.aggregate(p, start, step, lambda acc: acc["n"])

    found = let(w, lambda a: covered(let(F.sort_array(windows(a)), places)))
    return F.when(F.size(w) >= 3, found).otherwise(0).cast("long")


def text_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; columns of these names are replaced."""
    listed = docs.withColumn("_words", words(F.col(column)))
    return listed.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": word_chars(column),
            "n_symbols": n_symbols(column),
            "n_dup_lines": n_dup_lines(column),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    ).drop("_words")


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails`` is true; null counts as passed."""

    name: str
    fails: Column


def text_rules(column: str = "text") -> list[Rule]:
    """The production rules over the text alone; each computes only what it needs."""
    letters = F.length(F.regexp_replace(_text(column), "\\P{L}+", ""))
    return [
        Rule("too_short", n_words(column) < 50),
        Rule("repeated_words", let(words(F.col(column)), lambda w: 100 * repeated_words(w) > 50 * F.size(w))),
        Rule("symbols", 10 * n_symbols(column) > word_chars(column)),
        Rule("repeated_lines", 10 * n_dup_lines(column) > 3 * n_lines(column)),
        Rule("few_letters", 2 * letters < word_chars(column)),
    ]


def stat_rules(column: str = "text") -> list[Rule]:
    """The same rules for rows that carry ``text_stats`` already."""
    letters = F.length(F.regexp_replace(_text(column), "\\P{L}+", ""))
    return [
        Rule("too_short", F.col("n_words") < 50),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("word_chars")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * n_lines(column)),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
    ]


def sample(docs: DataFrame, size: int = SAMPLE_DOCS, key: str = "doc_id") -> DataFrame:
    """At most ``size`` ids with the least hashes, and their whole rows.

    Only ids meet in the final step; the texts are fetched by a broadcast semi
    join whose side has ``size`` rows at most.
    """
    ids = docs.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key, F.lit("rules")), key).limit(size)
    return docs.join(F.broadcast(ids), key, "left_semi")


def order_rules(rows: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """``rules`` by rejections per second on ``rows`` (a bounded sample), best first.

    Cost is the time of an aggregation over the stored sample, less that of an
    empty one; a rule that rejects nothing goes last. The order never changes
    what is rejected. An empty sample leaves the given order.
    """
    rows = rows.persist()
    try:
        if not rows.count():
            return list(rules)

        def timed(failing: Column) -> tuple[int, float]:
            begun = time.perf_counter()
            found = rows.agg(F.count_if(failing)).first()[0]
            return found, time.perf_counter() - begun

        timed(F.lit(False))
        floor = timed(F.lit(False))[1]
        gain = {}
        for rule in rules:
            rejected, seconds = min(timed(rule.fails) for _ in range(2))
            gain[rule.name] = rejected / max(seconds - floor, 1e-3)
        return sorted(rules, key=lambda r: -gain[r.name])
    finally:
        rows.unpersist()


def verdict(rules: Sequence[Rule]) -> Column:
    """True if no rule fails. CASE stops at the first that does, so later rules are not computed."""
    if not rules:
        return F.lit(True)
    branch = F.when(rules[0].fails, F.lit(False))
    for rule in rules[1:]:
        branch = branch.when(rule.fails, F.lit(False))
    return branch.otherwise(F.lit(True))


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``kept``: false if any rule rejects the document.

    Cost and selectivity of each rule come from a bounded sample of whole
    documents; rules run by rejection per cost and stop at the first rejection.
    Null and empty texts have no word and fail ``too_short``; long texts are
    read whole; repeated rows are judged alike; an empty table stays empty; a
    column ``kept`` of the input is replaced.
    """
    rules = list(text_rules() if rules is None else rules)
    return docs.withColumn("kept", verdict(order_rules(sample(docs, sample_docs), rules)))


def quality_report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The digest of the query: statistics of every document, ``base_failed`` and ``kept``."""
    docs = docs.select("doc_id", "text")
    ordered = order_rules(text_stats(sample(docs, sample_docs)), stat_rules())
    stats = text_stats(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict(ordered)).alias("kept"),
    )
