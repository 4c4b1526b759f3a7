"""Chat formatting with layouts found by schema fingerprint (operator 5), DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Template: HEAD role ":\n" text CLOSE. Inside texts and roles these strings are escaped.
HEAD, CLOSE = "### ", "</turn>\n"
# Turns formatted together before the turns of a conversation meet.
TURNS_PER_PART = 1024


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """A declared input shape: its field paths and how its fields become turns.

    ``turns`` lists (role, column) for one-row conversations; ``list_of`` names
    an array column with its (role, text) fields; neither: a row is a turn.
    """

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    list_of: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout(("conv_id", "turn", "role", "text")),
    Layout(("conv_id", "prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("conv_id", "system", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("conv_id", "instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("conv_id", "instruction", "input", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("conv_id", "messages[].role", "messages[].content"), list_of=("messages", "role", "content")),
    Layout(("conv_id", "conversations[].from", "conversations[].value"), list_of=("conversations", "from", "value")),
)
BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}
KNOWN = frozenset(p for x in LAYOUTS for p in x.paths)
# Role names of other layouts, by the canonical one.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def layout_of(df: DataFrame) -> Layout:
    """The layout whose fingerprint that of ``df`` equals; columns no layout knows don't count."""
    found = BY_FINGERPRINT.get(fingerprint(p for p in field_paths(df.schema) if p in KNOWN))
    if found is None:
        raise ValueError(f"no layout has the fields {sorted(field_paths(df.schema))}")
    return found


def canonical_turns(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of any known layout.

    Null texts become empty; optional parts of one-row layouts (system, input)
    that are null give no turn; other role names are mapped for list layouts.
    """
    layout = layout_of(df)
    if layout.turns:
        optional = {"system", "input"}
        made = [
            F.when(F.col(c).isNotNull() | F.lit(c not in optional), F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text")))
            for i, (role, c) in enumerate(layout.turns)
        ]
        turns = df.select("conv_id", F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))
    elif layout.list_of:
        column, role, text = layout.list_of
        one = df.select("conv_id", F.posexplode(column).alias("turn", "_m"))
        name = F.col("_m")[role]
        for other, canonical in ROLES.items():
            name = F.when(F.col("_m")[role] == other, canonical).otherwise(name)
        turns = one.select("conv_id", F.col("turn").cast("long"), name.alias("role"), F.col("_m")[text].alias("text"))
    else:
        turns = df.select("conv_id", "turn", "role", "text")
    return turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are cut out first, so ``\\h`` behind one is not taken for an escape."""
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(":\n"))
    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), plain), "\\")


def format_chat(df: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, and ``segments`` (piece, loss) that it consists of.

    The pieces with ``loss`` are the escaped assistant texts. Turns are
    formatted in parts of ``TURNS_PER_PART``, so a conversation of any length
    meets as few rows; its output is one value by definition. Turns are ordered
    by turn (null first), then role and text, so repeated rows stay, side by
    side. Null conv_id is a conversation; an empty table gives no row.
    """
    turns = canonical_turns(df)
    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":\n"), F.lit("\\c")), F.lit(":\n"))
    pieces = F.array(
        F.struct(head.alias("piece"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("piece"), (F.col("role") == "assistant").alias("loss")),
        F.struct(F.lit(CLOSE).alias("piece"), F.lit(False).alias("loss")),
    )
    part = F.floor(F.col("turn") / TURNS_PER_PART)
    keyed = turns.select("conv_id", part.alias("part"), F.struct("turn", "role", "text", pieces.alias("pieces")).alias("one"))
    parts = keyed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    parts = parts.select("conv_id", F.struct("part", F.flatten(F.transform("ones", lambda x: x["pieces"])).alias("pieces")).alias("one"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    whole = whole.select("conv_id", F.flatten(F.transform("ones", lambda x: x["pieces"])).alias("segments"))
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda x: x["piece"]), "").alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")
    body = lambda x: F.substring(x, len(HEAD) + 1, 2_147_483_647)
    cut = lambda x: F.split(x, ":\n", 2)
    return F.transform(turns, lambda x: F.struct(unescape(F.get(cut(body(x)), F.lit(0))).alias("role"), unescape(F.get(cut(body(x)), F.lit(1))).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["piece"])), "")


def chat_report(df: DataFrame) -> DataFrame:
    """The digest of the query, read back from the formatted output."""
    out = format_chat(df)
    read = out.withColumns({"turns": parse_chat(F.col("formatted")), "masked": loss_text(F.col("segments"))})
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
