"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declared template.

Everything is built-in column expressions. The output has one row per conversation, as a training sample does,
so a conversation's own rows meet in one row of output.

Defined cases: a null text or role is empty; a null `turn` sorts first; rows that share a turn number are ordered by
role, then text, and repeated rows stay; a null `conv_id` is a conversation of its own; an unknown role or a turn out
of order makes `valid` false and sets `bad_turn` (0-based position), but the conversation is still formatted whole;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like and which role may follow which.

    `moves` maps (state, role) to the next state; a pair that isn't there rejects. `before` and `after` enclose each
    text; `{role}` in `before` stands for the role. Both have to begin with a control string, and control strings
    begin with `<|`; `before` ends its role by a newline.
    """

    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "opened",
            ("start", "user"): "asked",
            ("opened", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)
    loss_roles: tuple[str, ...] = ("assistant",)
    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"


def escape(text: Column) -> Column:
    r"""Puts one more backslash between every `<` and `|`, so that no control string remains in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own: their percent signs, angle brackets and newlines are percent-encoded."""
    for char, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def turn_order(turns: Column, template: ChatTemplate) -> Column:
    """Struct of the state after the last turn and the position of the first turn that no move allows (or null)."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)))
    begin = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad_turn")
    )

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("rejected")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad_turn"], F.when(to.isNull(), acc["at"])).alias("bad_turn"),
        )

    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, segments array of (text, loss), formatted) for each conversation."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(
                    F.concat(F.lit(template.opening), escape_role(t["role"]), F.lit("\n")).alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    order = turn_order(F.col("turns"), template)
    return (
        grouped.withColumn("order", order)
        .withColumn("segments", segments)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            (F.col("order.bad_turn").isNull() & F.col("order.state").isin(*template.accepting)).alias("valid"),
            F.col("order.bad_turn").alias("bad_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Array of (role, text) that a formatted conversation holds, unescaped."""
    parts = F.slice(F.split(formatted, re.escape(template.opening), -1), 2, 1_000_000_000)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        length = F.length(part) - F.length(role) - 1 - len(template.closing)
        text = F.substring(part, F.length(role) + 2, length)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    marked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(marked, lambda s: unescape(s["text"])), "")
