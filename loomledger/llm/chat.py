"""Chat formatting by a finite-state machine over roles and a declarative template; DataFrame functions only.

A conversation becomes a list of segments (text, loss). Markers and text are told apart by characters: texts and role names are escaped so that none of `<`, `>`, `[` and `]` is left in them, hence no control string either, and nothing else opens or closes a turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for each reserved character. The backslash comes first when escaping and last when reading back.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"), ("[", "\\o"), ("]", "\\c"))


@dataclass(frozen=True)
class Template:
    """How turns look, and in which order roles may come. A turn is `open_` role `mid` text `close`, under the loss if its role is in `loss`."""

    begin: str = "<s>"
    open_: str = "[INST "
    mid: str = "]"
    close: str = "[/INST]"
    end: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a conversation is in order if it goes from `start` to a state in `final`.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def end_state(roles: Column, template: Template = Template()) -> Column:
    """The state of the machine after some roles, null if a role may not come where it does."""
    moves = F.create_map(*(F.lit(x) for state, to in template.moves.items() for role, new in to.items() for x in (f"{state}\n{role}", new)))
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.try_element_at(moves, F.concat(state, F.lit("\n"), role)))


def format_chats(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, segments, formatted, in_order): one row per conversation, turns by number (ties by role, then text).

    segments: array of (text, loss), whose texts in a row are `formatted`. Null roles and texts are empty. A conversation out of order is formatted as it is, with in_order false. Rows without a conv_id are one conversation; repeated rows are repeated turns.
    """
    own = turns.select(F.col(conv_id).alias("c"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    chats = own.groupBy("c").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def parts(r: Column) -> Column:
        fixed = lambda s, loss=False: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
        return F.array(fixed(F.concat(F.lit(template.open_), escape(r["role"]), F.lit(template.mid))), F.struct(escape(r["text"]).alias("text"), r["role"].isin(*template.loss).alias("loss")), fixed(F.lit(template.close)))

    edge = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(edge(template.begin), F.flatten(F.transform("rows", parts)), edge(template.end))
    state = end_state(F.transform("rows", lambda r: r["role"]), template)
    out = chats.select(F.col("c").alias(conv_id), F.size("rows").cast("long").alias("n_turns"), segments.alias("segments"), F.coalesce(state.isin(*template.final), F.lit(False)).alias("in_order"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    inner = F.substr(formatted, F.lit(len(template.begin) + 1), F.length(formatted) - len(template.begin) - len(template.end))
    pieces = F.filter(F.split(inner, "\\Q" + template.close + "\\E", -1), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(template.open_) + 1)), template.mid, 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring_index(p, template.mid, -1)).alias("text")))


def digests(chats: DataFrame, template: Template = Template(), conv_id: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, read back from them: turns from the string, the text under the loss from the segments' flags."""
    turns = read_back(F.col("formatted"), template)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.withColumn("turns", turns).withColumn("loss_text", loss).select(conv_id, F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "in_order")
