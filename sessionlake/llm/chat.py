"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts. A visitor, one expression per part type,
flattens them in order: text stands as it is, an image, audio clip or document
becomes one placeholder, with an attachment record of its source, its ordinal
and the number of tokens that it will expand to. A conversation is then
<|im_start|>role, a new line, the content, <|im_end|> and a new line per turn.

Control strings inside texts and roles are escaped: a backslash goes between
their first character and the rest, and a run of backslashes that stands there
already grows by one, so that unescaping takes one away and restores the text.
No control string of the template is left inside a turn.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template, and those of others that must not appear by accident.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
START, END = "<|im_start|>", "<|im_end|>\n"

#: Pixels of an image's side that one token stands for; tokens of a second of audio, and of a page.
IMAGE_PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512

PARTS = "array<struct<type string, text string, uri string, width int, height int, seconds double, pages int>>"

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_FOUND = rf"([<\[])(\\*)(?={_TAILS})"
_ESCAPED = rf"([<\[])(\\*)\\(?={_TAILS})"


def escape(text: Column) -> Column:
    """A text without control strings, from which unescape() restores it."""
    return F.regexp_replace(text, _FOUND, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    quoted = F.replace(unescape(role), F.lit("\\\\"), F.lit("\u0000\u0001\u0000"))
    return F.replace(F.replace(quoted, F.lit("\\n"), F.lit("\n")), F.lit("\u0000\u0001\u0000"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The parts of a turn that is a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type string, text string>>")


def _visit(part: Column, field: dict[str, bool]) -> Column:
    """What a part adds: (text, type, uri, tokens), by its type; an unknown type adds its text."""

    def get(name: str, kind: str) -> Column:
        return part[name].cast(kind) if field.get(name) else F.lit(None).cast(kind)

    side = lambda name: F.ceil(F.greatest(F.coalesce(get(name, "double"), F.lit(1.0)), F.lit(1.0)) / IMAGE_PATCH)
    kind = F.coalesce(part["type"], F.lit("text"))
    tokens = (
        F.when(kind == "image", side("width") * side("height"))
        .when(kind == "audio", F.ceil(F.greatest(F.coalesce(get("seconds", "double"), F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS))
        .when(kind == "document", F.greatest(F.coalesce(get("pages", "long"), F.lit(1)), F.lit(1)) * PAGE_TOKENS)
    )
    attached = kind.isin("image", "audio", "document")
    return F.struct(
        F.when(attached, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(get("text", "string"), F.lit("")))).alias("text"),
        F.when(attached, kind).alias("type"),
        get("uri", "string").alias("uri"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
    )


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: (conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens).

    parts: an array of structs with at least type and text. loss_spans are
    (turn_index, start, end), in code points of formatted, end exclusive: the contents of
    turns whose role is in learn_from. attachments are (turn_index, type, uri,
    tokens) in order. Null parts and texts are empty, a null role is the empty
    role, a null conversation id is a conversation of its own. Turns stand by
    turn, nulls first, then by role and content, so rows that repeat or share a
    turn have a fixed order and all stay. Other columns are left out; an empty
    table gives no rows.

    A turn is rendered where it is read, the rendered turns of a conversation
    meet in one shuffle by its id, and positions are running sums over them.
    """
    field = {f.name: True for f in turns.schema[parts].dataType.elementType.fields}
    visited = F.transform(F.coalesce(F.col("_parts"), F.array().cast(turns.schema[parts].dataType)), lambda p: _visit(p, field))
    rendered = (
        turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.col(parts).alias("_parts"))
        .withColumn("_visited", visited)
        .select(
            "conv_id",
            "_turn",
            F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n")).alias("_head"),
            F.array_join(F.transform("_visited", lambda v: v["text"]), "").alias("_content"),
            F.filter(F.transform("_visited", lambda v: F.struct(v["type"].alias("type"), v["uri"].alias("uri"), v["tokens"].alias("tokens"))), lambda v: v["type"].isNotNull()).alias("_files"),
            F.col("_role").isin(*learn_from).alias("_learn"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_head", "_content")
    size = F.char_length("_head") + F.char_length("_content") + len(END)
    placed = (
        rendered.withColumn("_index", F.row_number().over(order))
        .withColumn("_end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(END))
        .select(
            "conv_id",
            F.struct(
                "_index",
                F.concat("_head", "_content", F.lit(END)).alias("segment"),
                F.when(F.col("_learn"), F.struct((F.col("_index") - 1).alias("turn_index"), (F.col("_end") - F.char_length("_content")).alias("start"), F.col("_end").alias("end"))).alias("span"),
                F.transform("_files", lambda f: F.struct((F.col("_index") - 1).alias("turn_index"), f["type"].alias("type"), f["uri"].alias("uri"), f["tokens"].alias("tokens"))).alias("files"),
            ).alias("_turn"),
        )
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["segment"]), "").alias("formatted"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.filter(F.transform("_turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("_turns", lambda t: t["files"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped. Placeholders stay as they are."""
    split = F.filter(F.split(formatted, re.escape(START), -1), lambda s: s != "")
    return F.transform(split, lambda s: F.struct(unescape_role(F.substring_index(s, "\n", 1)).alias("role"), unescape(F.substring(s, F.locate("\n", s) + 1, F.char_length(s) - F.locate("\n", s) - len(END))).alias("text")))


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order. A span ends where its turn's segment does, but for the end mark."""
    segments = F.array(F.split(formatted, re.escape(START), -1))

    def cut(segment: Column, span: Column) -> Column:
        size = (span["end"] - span["start"]).cast("int")
        return unescape(F.substring(segment, F.char_length(segment) - len(END) - size + 1, size))

    return F.array_join(F.element_at(F.transform(segments, lambda all_: F.transform(spans, lambda s: cut(F.get(all_, s["turn_index"] + 1), s))), 1), "")
