"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events with a sequence number.  Events of a message are folded in that order: a delta
adds text, an edit or a regeneration replaces what was there, a deletion ends the message.  Messages are rendered
through a template whose marks are escaped inside texts, and the loss mask is kept as spans of the output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event kinds: what each does to the text of its message.
DELTA, EDIT, REGENERATE, DELETE = "delta", "edit", "regenerate", "delete"


@dataclass(frozen=True)
class Template:
    """A turn is `turn`, role, `body`, text, `end`.  Marks and `foreign` control strings are escaped inside roles and texts.

    Every control string starts with < or [ and holds neither further on.  Escaping puts a backslash behind that first
    character, or one more where there are some already; taking one out again restores any text.
    """

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "[SYS]", "[/SYS]")

    def __post_init__(self) -> None:
        for s in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\]+", s):
                raise ValueError(f"a control string starts with < or [ and holds neither further on, nor a backslash: {s!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, *self.foreign)

    def pattern(self, slash: str) -> str:
        tails = {first: "|".join(re.sub(r"([^\w\s])", r"\\\1", s[1:]) for s in self.controls if s[0] == first) for first in "<["}
        return "|".join(f"(?<=\\{first}){slash}(?=\\\\*(?:{tail}))" for first, tail in tails.items() if tail)

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, self.pattern(""), r"\\")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, self.pattern(r"\\"), "")


def fold(events: DataFrame, keys: list[str], msg: str = "msg", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(keys, msg, role, text): the messages that the event logs leave.

    Rows of a message are ordered by seq, nulls first; events with equal seq by kind and text.  Null text: empty.  Null
    kind: delta.  Role: that of the message's first event that has one.  Deltas of the last edit or regeneration's
    sequence on are kept; the earlier ones are dropped before the lists are joined.
    """
    e = events.select(*keys, F.col(msg).alias("msg"), F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit(DELTA)).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(role).alias("role")).alias("e"))
    g = e.groupBy(*keys, "msg").agg(F.array_sort(F.collect_list("e")).alias("log"))
    resets = F.transform("log", lambda x, i: F.when(x["kind"] != DELTA, i).otherwise(F.lit(-1)))
    g = g.withColumn("from", F.array_max(resets))
    last = F.expr("if(`from` >= 0, element_at(log, `from` + 1).kind, 'delta')")
    tail = F.expr("if(`from` >= 0, slice(log, `from` + 1, size(log) - `from`), log)")
    known = F.filter("log", lambda x: x["role"].isNotNull())
    g = g.where(last != DELETE)
    return g.select(*keys, "msg", F.expr("1").alias("__one"), F.when(F.size(known) > 0, F.element_at(known, 1)["role"]).alias("role"), F.array_join(F.transform(tail, lambda x: x["text"]), "").alias("text")).drop("__one")


def render(messages: DataFrame, keys: list[str], template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",), order: str = "msg") -> DataFrame:
    """(keys, formatted, spans): one row per conversation.

    spans: turn (number of the turn), turn_start, start and stop (in code points of `formatted`): the loss mask, each text
    of a loss role once.  Turns are escaped and measured apart; only finished turns meet in their conversation's row.
    """
    m = messages.select(
        *keys,
        F.col(order).alias("__order"),
        template.escape(F.coalesce("role", F.lit(""))).alias("__role"),
        template.escape(F.coalesce("text", F.lit(""))).alias("__text"),
        F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("__loss"),
    )
    m = m.withColumn("__head", F.concat(F.lit(template.turn), "__role", F.lit(template.body)))
    m = m.withColumn("__turn", F.concat("__head", "__text", F.lit(template.end)))
    by = Window.partitionBy(*keys).orderBy("__order", "__turn")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("__i", F.row_number().over(by) - 1).withColumn("__start", F.coalesce(F.sum(F.length("__turn")).over(before), F.lit(0)).cast("long"))
    span = F.struct(
        F.col("__i").alias("turn"),
        F.col("__start").alias("turn_start"),
        (F.col("__start") + F.length("__head")).alias("start"),
        (F.col("__start") + F.length("__head") + F.length("__text")).alias("stop"),
    )
    g = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__turn"))).alias("turns"), F.array_sort(F.collect_list(F.when(F.col("__loss"), span))).alias("spans"))
    return g.select(*keys, F.array_join(F.transform("turns", lambda t: t["__turn"]), "").alias("formatted"), "spans")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds `turns` (role and text of each, unescaped) and `loss_texts`, both read from `formatted` and `spans`."""
    pieces = F.expr(f"slice(split(formatted, '{re.escape(template.turn)}', -1), 2, 2147483647)".replace("\\", "\\\\"))
    f = formatted.withColumn("__pieces", pieces)
    body, end, n = template.body, template.end, len(template.turn)

    def turn(p: Column) -> Column:
        at = F.instr(p, body)
        text = F.substring(p, at + len(body), F.length(p) - at - len(body) + 1 - len(end))
        return F.struct(template.unescape(F.substring(p, F.lit(1), at - 1)).alias("role"), template.unescape(text).alias("text"))

    def masked(s: Column) -> Column:
        piece = F.element_at(F.col("__pieces"), s["turn"] + 1)
        start = (s["start"] - s["turn_start"] - n).cast("int")
        return template.unescape(F.substring(piece, start + 1, (s["stop"] - s["start"]).cast("int")))

    return f.withColumn("turns", F.transform("__pieces", turn)).withColumn("loss_texts", F.transform("spans", masked)).drop("__pieces")


def format_chats(events: DataFrame, keys: list[str], template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",), **names: str) -> DataFrame:
    """Fold event logs and render them: (keys, formatted, spans), one row per conversation that has a message left.

    Null keys: a conversation like others.  Null message number: sorts first.  Null or empty texts: empty turns.
    Null role: empty, outside the loss.  Repeated events are applied as often as they are there.  Messages with
    equal numbers in different keys are independent.  Empty table: no rows.  Other columns are not read.
    A conversation's output is one string, so a conversation must fit in a row; its log need not, as it
    is folded message by message first.
    """
    return render(fold(events, keys, **names), keys, template, loss_roles)
