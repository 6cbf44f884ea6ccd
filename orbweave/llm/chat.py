"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A declarative template says what stands before and after each turn and which roles bear loss.
Per conversation the machine folds over the roles in turn order: it yields the text segments,
each with a loss flag, and whether the order of turns is one that the transitions allow.
Control strings inside texts and roles are escaped reversibly: "~" becomes "~0", the opening
of a control string "<|" becomes "<~1", and a line feed in a role becomes "~2".

Defined results: null text and null role count as empty; turns are ordered by turn (null
first), role, text, so ties have one order and repeated rows stay repeated; null conv_id is one
conversation; an empty table gives an empty result; other columns are not read. A conversation
is one row, as its digest needs all of it in order; its turns must fit a row (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, who bears loss, and which role may follow which."""

    opens: str = "<|im_start|>"
    after_role: str = "\n"
    closes: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple = ("assistant",)
    transitions: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",),
    })


CHAT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation: conv_id, n_turns, valid, segments (text, loss) and formatted text."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in template.transitions.items() for b in after])
    rows = turns.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    state = F.aggregate(
        "turns", F.lit("start"),
        lambda s, t: F.when(F.array_contains(allowed, F.concat(s, F.lit(">"), t["role"])), t["role"]).otherwise(F.lit("error")))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.opens), _role_out(t["role"]), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.closes + template.after_turn).alias("text"), F.lit(False).alias("loss")),
    )))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), (state != "error").alias("valid"), segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, valid, formatted, loss_text and turns (role, text), parsed from the output alone."""
    parts = F.split("formatted", _literal(template.opens))
    blocks = F.slice(parts, F.lit(2), F.size(parts))
    end = template.closes + template.after_turn

    def turn(block: Column) -> Column:
        at = F.locate(template.after_role, block)
        role = F.substring(block, F.lit(1), at - 1)
        rest = F.substring(block, at + len(template.after_role), F.length(block))
        text = F.substring(rest, F.lit(1), F.length(rest) - len(end))
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select("conv_id", "valid", "formatted", F.array_join(loss, "").alias("loss_text"), F.transform(blocks, turn).alias("turns"))


def _literal(text: str) -> str:
    """A regular expression that matches text only."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def chat_digests(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """The digests of op7, all computed from what read_back() finds in the output."""
    back = read_back(format_chats(turns, template), template)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
