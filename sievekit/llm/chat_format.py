r"""Chat formatting by a finite-state machine over roles (operator 12).

The machine's state is the kind of the last role read. A declarative template
names the roles that may follow each state, the marks around a turn and the
segments under the loss mask. A turn is three segments: head, text and end
mark, each with its loss flag; a conversation's formatted text is all of them
in order. Turns that the machine does not allow are formatted too, and the
conversation is reported as not valid, with its first such turn.

Control strings inside texts and roles are escaped so that neither mark can
occur there: a backslash is doubled, and a control string gets a backslash
after its first character. Undoing it takes one pass: a backslash stands for
the character behind it. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, OTHER = "start", "other"


@dataclass(frozen=True)
class Template:
    """Marks, machine and loss mask of a chat format.

    ``follow`` maps a state (``start``, a role, or ``other`` for any role not
    named) to the roles that may come next; ``final`` holds the states a
    conversation may end in; ``loss`` the roles whose text is learnt. No mark
    may begin inside another one or inside itself.
    """

    head: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant",)})
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def _escape(text: Column, controls: tuple[str, ...]) -> Column:
    """Double backslashes, then a backslash after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in controls:
        out = F.regexp_replace(out, f"{re.escape(mark[0])}(?={re.escape(mark[1:])})", f"\\{mark[0]}" + r"\\")
    return out


def unescape(text: Column) -> Column:
    """The text that ``_escape`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _state(role: Column, template: Template) -> Column:
    """The state that reading ``role`` leads to."""
    named = sorted(({*template.follow} | {r for rs in template.follow.values() for r in rs}) - {START, OTHER})
    return F.when(role.isin(named), role).otherwise(F.lit(OTHER))


def _allowed(state: Column, role: Column, template: Template) -> Column:
    out = F.lit(False)
    for at, roles in sorted(template.follow.items()):
        out = F.when(state == at, role.isin(list(roles))).otherwise(out)
    return out


def turn_segments(conversations: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id") -> DataFrame:
    """One row per turn: ``id, pos, state, ok, segments`` with segments ``(text, loss)`` of head, text and end mark.

    ``pos`` counts from 0 in the order of turn (null first), role and text.
    ``state`` is the machine's state before the turn.
    """
    rows = conversations.select(
        F.col(id_col).alias("__id"), F.col("turn").alias("__turn"), F.coalesce("role", F.lit("")).alias("__role"),
        F.coalesce("text", F.lit("")).alias("__text"))
    order = Window.partitionBy("__id").orderBy(F.col("__turn").asc_nulls_first(), "__role", "__text")
    before = F.lag(_state(F.col("__role"), template)).over(order)
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long") - 1).withColumn(
        "state", F.coalesce(before, F.lit(START)))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = F.concat(F.lit(template.head), _escape(F.col("__role"), (*template.control, template.after_role)),
                    F.lit(template.after_role))
    segments = F.array(
        segment(head, F.lit(False)),
        segment(_escape(F.col("__text"), template.control), F.col("__role").isin(list(template.loss))),
        segment(F.lit(template.end), F.lit(False)))
    return rows.select(F.col("__id").alias("id"), "pos", "state", _state(F.col("__role"), template).alias("next_state"),
                       _allowed(F.col("state"), F.col("__role"), template).alias("ok"), segments.alias("segments"))


def format_chats(conversations: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``id_col, n_turns, segments, valid, first_bad_turn``.

    Null role and text are empty; rows without an id are one conversation with
    a null id; repeated rows are turns of their own; other columns are not
    read; an empty table gives an empty result. A conversation is one row of
    the result, so it must fit in one (2 GB). ``first_bad_turn`` is the
    position of the first turn the machine does not allow, the number of turns
    if only the end is wrong, null if ``valid``.
    """
    turns = turn_segments(conversations, template, id_col)
    chats = turns.groupBy("id").agg(
        F.count("*").alias("n_turns"), F.min(F.when(~F.col("ok"), F.col("pos"))).alias("bad"),
        F.max_by("next_state", "pos").alias("last"),
        F.array_sort(F.collect_list(F.struct("pos", "segments"))).alias("turns"))
    bad = F.coalesce("bad", F.when(~F.col("last").isin(list(template.final)), F.col("n_turns")))
    return chats.select(F.col("id").alias(id_col), "n_turns", F.flatten(F.col("turns.segments")).alias("segments"),
                        bad.isNull().alias("valid"), bad.alias("first_bad_turn"))


def formatted(segments: Column) -> Column:
    """The formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_chat(text: Column, template: Template = DEFAULT) -> Column:
    """``(role, text)`` turns of a formatted text: the marks cut it, then both parts are unescaped.

    An end mark cannot begin inside an escaped text, and no proper end of it
    is its beginning, so the first one found is the turn's own.
    """
    pieces = F.split(text, re.escape(template.end))
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands behind the last end mark
    h, a = len(template.head), len(template.after_role)
    cut = lambda p: F.instr(p, template.after_role)
    return F.transform(turns, lambda p: F.struct(
        unescape(F.substr(p, F.lit(h + 1), cut(p) - 1 - h)).alias("role"),
        unescape(F.substr(p, cut(p) + a)).alias("text")))
