"""Chat formatting: typed content parts flattened into one marked string.

A turn holds an array of parts ``struct<type, text, ref, units>``. A visitor over
that array writes text parts with their control strings escaped and puts an
ordered placeholder ``<image:k>``, ``<audio:k>`` or ``<document:k>`` for every
other part, recording its reference and how many tokens it expands to
(``units`` are image tiles, audio seconds or document pages).

Template: a turn is ``<s>`` role newline text ``</s>``. Every ``<`` and backslash
of a role or text is escaped (``<`` is followed by a backslash, a backslash is
doubled, a newline in a role becomes ``<\\n``), so that a control string is
always a ``<`` without a backslash behind it, and reading back is exact. The loss
mask is a list of code-point ranges over the formatted string, one for each turn
of the trained role.

Only DataFrame functions are used. Offsets come from a running sum over the turns
of a conversation; one conversation is one string, so its rows meet in one place.

Cases: null text, null role and null parts are empty; turns with equal numbers
are ordered by role, then text; null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
"""Tokens that a tile, a second and a page expand to."""
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\"), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<n"), F.lit("\n")))


def text_part(c: Column) -> Column:
    """A plain text as an array of one part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")))


def visit(parts: Column) -> tuple[Column, Column]:
    """(text with placeholders, attachments) of one turn's parts.

    Placeholders are numbered from 1 within the turn, over all types. A null
    array is empty; a part of an unknown type is treated as text.
    """
    parts = F.coalesce(parts, F.expr("array()").cast("array<struct<type:string,text:string,ref:string,units:bigint>>"))
    attached = F.coalesce(F.filter(parts, lambda p: p["type"].isin(*TOKENS_PER_UNIT)), F.array())
    number = F.transform(
        parts,
        lambda p, i: F.when(p["type"].isin(*TOKENS_PER_UNIT), F.size(F.filter(F.slice(parts, 1, i + 1), lambda q: q["type"].isin(*TOKENS_PER_UNIT)))),
    )
    text = F.array_join(
        F.zip_with(
            parts,
            number,
            lambda p, n: F.when(n.isNotNull(), F.concat(F.lit("<"), p["type"], F.lit(":"), n, F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
        ),
        "",
    )
    cost = F.create_map(*(F.lit(x) for pair in TOKENS_PER_UNIT.items() for x in pair))
    attachments = F.transform(
        attached,
        lambda p, i: F.struct((i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), (F.element_at(cost, p["type"]) * F.coalesce(p["units"], F.lit(1))).alias("tokens")),
    )
    return text, attachments


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments.

    ``loss_mask`` is an array of (start, end) over ``formatted``; ``attachments``
    has the turn's place (from 0), number, type, ref and tokens of each part.
    """
    text, attachments = visit(F.col("parts"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(parts).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", text.alias("text"), attachments.alias("attachments"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("piece", F.concat("head", "text", F.lit(CLOSE)))
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.length("piece") + F.length("head")
    trained = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), (start + F.length("text")).alias("end")))
    turn_row = F.struct("place", "piece", trained.alias("loss"), "attachments")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn_row)).alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"].isNotNull()), lambda x: x["loss"]).alias("loss_mask"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["place"].alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the text under the loss mask, from the formatted string alone and its mask."""
    pieces = F.split(F.substring(F.col("formatted"), len(OPEN) + 1, 2**31 - 1), CLOSE + f"({OPEN})?")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # what stands behind the last mark is empty
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.select("*", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
