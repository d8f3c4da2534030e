"""Conversations as marked text with a loss mask, by a declarative template.

A template says how each role's turn is marked, whether its text is trained on, and, as a
finite-state machine, which role may follow which.  A conversation becomes a list of segments
``(text, loss)``; joined, they are the formatted text.  Marks carry no loss, so the text under
the mask is each trained turn's text and nothing else.

Control strings inside texts are escaped: a backslash is doubled, and a control string gets a
backslash after its first character, which no control string holds.  Every control string
begins with a character that none holds further on, so none can arise across a border either.

Everything is a Spark built-in function.  Texts are escaped before the shuffle; a conversation
is one record and one row, as its digest and its training example are, so its length alone
bounds what a task holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"
_BACK = "\\"


@dataclass(frozen=True)
class Turn:
    begin: str
    end: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; any other role's turn is ``other`` with the role's name before ``named``.

    ``moves[state][role]`` is the state after a turn; a role without a move is refused, which
    is reported and leaves the state.  A conversation is valid if none of its turns is refused
    and it ends in one of ``final``.
    """

    turns: dict[str, Turn]
    other: Turn
    named: str
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"
    final: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for mark in self.controls():
            if len(mark) < 2 or _BACK in mark or any(c[0] in mark[1:] for c in self.controls()):
                raise ValueError(f"not a control string that can be escaped: {mark!r}")
        begins = [self.other.begin, *(t.begin for t in self.turns.values())]
        if any(a != b and b.startswith(a) for a in begins for b in begins) or len(set(begins)) < len(begins):
            raise ValueError("turns must begin differently")

    def controls(self) -> list[str]:
        marks = [self.named, *(m for t in (self.other, *self.turns.values()) for m in (t.begin, t.end))]
        return sorted({m.strip() for m in marks})


CHAT = Template(
    turns={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[ANS] ", "</s>", loss=True),
    },
    other=Turn("[TURN] ", " [/TURN]"),
    named=" [SAYS] ",
    moves={
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=("answered",),
)


def escape(text: Column, template: Template) -> Column:
    controls = template.controls()
    first = "".join(sorted({re.escape(c[0]) for c in controls}))
    broken = "(?=" + "|".join(re.escape(c) for c in controls) + ")(.)"
    doubled = F.when(F.contains(text, F.lit(_BACK)), F.replace(text, F.lit(_BACK), F.lit(_BACK * 2))).otherwise(text)
    return F.when(text.rlike(f"[{first}]"), F.regexp_replace(doubled, broken, r"$1\\")).otherwise(doubled)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(_BACK)), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _pick(role: Column, template: Template, value) -> Column:
    """By role, ``value`` of its turn and whether it is a named one."""
    cases = F.when(F.lit(False), value(template.other, False))
    for name, turn in template.turns.items():
        cases = cases.when(role == name, value(turn, True))
    return cases.otherwise(value(template.other, False))


def _checked(roles: Column, template: Template) -> Column:
    """The machine run over a conversation's roles: last state, turns so far, refused ones, the first of them."""
    moves = F.create_map(*[
        F.lit(part) for state, to in template.moves.items() for role, after in to.items() for part in (f"{state}\n{role}", after)
    ]) if template.moves else F.create_map().cast("map<string,string>")
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("turns"), F.lit(0).alias("refused"), F.lit(None).cast("int").alias("first_refused"))

    def step(at: Column, role: Column) -> Column:
        after = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role))
        bad = after.isNull()
        return F.struct(
            F.coalesce(after, at["state"]).alias("state"), (at["turns"] + 1).alias("turns"), (at["refused"] + bad.cast("int")).alias("refused"),
            F.coalesce(at["first_refused"], F.when(bad, at["turns"])).alias("first_refused"),
        )

    return F.aggregate(roles, start, step)


def format(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as ``conv_id, segments, valid, refused, first_refused``.

    Turns come by number (null first), then role, then text.  A null text or role is empty; rows
    without a ``conv_id`` are one conversation.  ``first_refused`` counts from 0, null if none is.
    """
    role = F.coalesce("role", F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn"), role.alias("role"), escape(F.coalesce("text", F.lit("")), template).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def segments(t: Column) -> Column:
        def one(turn: Turn, known: bool) -> Column:
            begin = F.lit(turn.begin) if known else F.concat(F.lit(turn.begin), escape(t["role"], template), F.lit(template.named))
            parts = [(begin, False), (t["text"], True), (F.lit(turn.end), False)] if turn.loss else [(F.concat(begin, t["text"], F.lit(turn.end)), False)]
            return F.array(*[F.struct(text.alias("text"), F.lit(loss).alias("loss")) for text, loss in parts])

        return _pick(t["role"], template, one)

    ran = whole.select("conv_id", F.flatten(F.transform("t", segments)).cast(SEGMENTS).alias("segments"), _checked(F.col("t.role"), template).alias("_c"))
    valid = (F.col("_c.refused") == 0) & F.col("_c.state").isin(*template.final)
    return ran.select("conv_id", "segments", valid.alias("valid"), "_c.refused", "_c.first_refused")


def write(rows: DataFrame, path: str, template: Template = CHAT) -> None:
    format(rows, template).write.option("compression", "zstd").parquet(path)


def joined(segments: str = "segments") -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def trained(segments: str = "segments") -> Column:
    """The text under the loss mask, as it was before the escape."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns ``(role, text)`` that a formatted text holds: the reverse of :func:`format`."""
    ends = "|".join(re.escape(e) for e in sorted({t.end for t in (template.other, *template.turns.values())}, key=len, reverse=True))
    pieces = F.split(formatted, ends, -1)

    def turn(piece: Column) -> Column:
        def after(mark: str) -> Column:
            return piece.substr(F.lit(len(mark) + 1), F.length(piece))

        rest, named = after(template.other.begin), F.lit(template.named)
        other = F.struct(unescape(F.substring_index(rest, template.named, 1)).alias("role"),
                         unescape(rest.substr(F.locate(template.named, rest) + F.length(named), F.length(rest))).alias("text"))
        got = F.when(F.lit(False), other)
        for role, marks in template.turns.items():
            got = got.when(F.startswith(piece, F.lit(marks.begin)), F.struct(F.lit(role).alias("role"), unescape(after(marks.begin)).alias("text")))
        return got.otherwise(other)

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read(spark: SparkSession, path: str, template: Template = CHAT) -> DataFrame:
    """What :func:`write` wrote, with ``formatted``, the ``turns`` read back from it and ``trained``."""
    rows = spark.read.parquet(path)
    return rows.withColumn("formatted", joined()).withColumn("turns", parse(F.col("formatted"), template)).withColumn("trained", trained())
