"""Chat formatting by a declarative template, in DataFrame functions only.

A finite-state machine over the roles checks the order of turns; each turn becomes text
segments, and a segment says whether the loss counts its text. A control string inside a
role or text is escaped: ``<``, any number of backslashes and ``|`` get one backslash
more, so no text can hold ``<|`` and the marks of the template are the only ones.

Defined results: a null text or role is empty; a conversation out of order is formatted all
the same, with ``valid`` false and the first offending turn; turns of equal number are
ordered by role and text, and repeated rows are turns of their own; rows with a null id
are one conversation; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles whose text is learned, and allowed steps ``(state, role) -> state``."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "ready",
            (START, "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("asked", "answered")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    # A role ends at a line feed, so its own become a mark no text can hold.
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def _check(turns: Column, template: Template) -> Column:
    """``{state, bad}``: the state after all turns, and the first turn (from 0) that no step allows, else -1."""

    def step(acc: Column, turn: Column) -> Column:
        following = F.lit(None).cast("string")
        for (state, role), to in template.steps.items():
            following = F.when((acc["state"] == state) & (turn["role"] == role), to).otherwise(following)
        wrong = following.isNull()
        bad = F.when((acc["bad"] < 0) & wrong, acc["n"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(following, acc["state"]).alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    begin = F.struct(F.lit(START).alias("state"), F.lit(-1).cast("long").alias("bad"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(turns, begin, step)


def format_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, formatted, segments, valid, first_bad_turn``; a segment is ``{text, loss}``.

    ``formatted`` is all segments one after another. A conversation is one row, as the
    text it becomes is.
    """
    template = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chats.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.begin), _escape_role(t["role"]), F.lit(template.after_role))
        return F.array(
            piece(head, F.lit(False)), piece(escape(t["text"]), t["role"].isin(*template.learned)), piece(F.lit(template.end), F.lit(False))
        )

    rows = rows.select(
        "conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _check(F.col("turns"), template).alias("check")
    )
    return rows.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        (F.col("check.bad").eqNullSafe(-1) & F.col("check.state").isin(*template.final)).alias("valid"),
        F.when(F.col("check.bad") >= 0, F.col("check.bad")).alias("first_bad_turn"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns ``{role, text}`` back from a formatted text."""
    template = template or Template()
    quoted = "".join("\\" + c if not c.isalnum() and c not in "\n " else c for c in template.end)
    parts = F.split(formatted, quoted)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last mark

    def parse(part: Column) -> Column:
        body = F.substring(part, len(template.begin) + 1, F.length(part))
        role = F.substring_index(body, template.after_role, 1)
        text = F.substring(body, F.length(role) + len(template.after_role) + 1, F.length(body))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, parse)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
