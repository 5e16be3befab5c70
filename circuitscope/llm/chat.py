"""Chat formatting by a declarative template: DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: In front of what was changed in a text: ``\\\\`` stands for a backslash, ``\\.`` breaks a control string.
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings around a turn (open, role, body, text, close); the turn order; the roles to learn from.

    ``turns`` maps each state to the roles that may come next; a role is the state after its turn. A
    conversation may end in the states of ``final``. A control string's first character must not come again in it, and
    none may hold the escape character: then a marked turn can be cut out again whatever texts say.
    """

    open: str = "<|turn|>"
    body: str = "<|text|>"
    close: str = "<|end|>"
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in self.controls:
            if not control or ESCAPE in control or control[0] in control[1:]:
                raise ValueError(f"not a usable control string: {control!r}")
        if len({*self.controls}) < 3:
            raise ValueError("control strings must differ")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.open, self.body, self.close


def escape(text: Column, template: Template) -> Column:
    """Double each backslash, then put a backslash and a full stop behind the first character of each control string."""
    found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(found), F.lit(r"$0\\."))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(?:(\\)|\.)"), F.lit("$1"))


def _problem(turns: Column, template: Template) -> Column:
    """Null if the roles' order is one that the template allows, else the first turn that breaks it."""
    steps = F.create_map(*[F.lit(x) for state, roles in template.turns.items() for role in roles for x in (f"{state}>{role}", role)])

    def step(state: Column, turn: Column) -> Column:
        after = F.try_element_at(steps, F.concat(state["at"], F.lit(">"), turn["role"]))
        bad = F.concat(F.lit("turn "), state["n"].cast("string"), F.lit(": "), turn["role"], F.lit(" after "), state["at"])
        return F.struct(F.coalesce(after, turn["role"]).alias("at"), (state["n"] + 1).alias("n"),
                        F.coalesce(state["bad"], F.when(after.isNull(), bad)).alias("bad"))

    end = F.aggregate(turns, F.struct(F.lit("start").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("bad")), step)
    return F.coalesce(end["bad"], F.when(~end["at"].isin(*template.final), F.concat(F.lit("ends after "), end["at"])))


def format_conversations(rows: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation: id, segments, valid, problem.

    ``segments``: what the formatted text consists of, in order, each piece with a loss flag; only the escaped texts
    of ``loss_roles`` have it. Conversations that break the turn order are formatted all the same and
    say so in ``valid`` and ``problem``. Turns are ordered by turn, role and text (nulls first), so repeated or
    tied rows have one result; null roles and texts are empty; null ids are one conversation. A
    conversation is one output row, so its turns meet in one task, and only they do.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.body))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                       piece(F.lit(template.close), F.lit(False)))

    return (grouped.withColumn("problem", _problem(F.col("turns"), template))
            .select(id_col, F.flatten(F.transform("turns", pieces)).alias("segments"), F.col("problem").isNull().alias("valid"), "problem"))


def formatted_text(segments: Column | str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted text: the way back."""
    parts = F.split(formatted, re.escape(template.close))
    marked = F.slice(parts, 1, F.size(parts) - 1)  # behind the last close there is nothing

    def turn(part: Column) -> Column:
        at = F.instr(part, template.body)
        role = F.substring(part, F.lit(len(template.open) + 1), at - len(template.open) - 1)
        text = F.substring(part, at + len(template.body), F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(marked, turn)


def loss_text(segments: Column | str = "segments") -> Column:
    """The unescaped text under the loss flags, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
