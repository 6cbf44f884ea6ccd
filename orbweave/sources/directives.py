"""Suppression directives from comments, by a table function.

A comment is a directive if, without comment marks and blanks around it, it begins with @ and one of the
namespaces; then come a verb, rule names divided by blanks or commas, and a reason behind the first "--". No
names, or "all", mean every rule. Names that are no rules are passed over, but a directive that names nothing
else says nothing, rather than cover every rule. Everything else gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACES = ("ow:", "orbweave:")
#: The verbs.
VERBS = ("accept", "accept:this", "accept:next", "disable", "enable")
BLANKS = " \t\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def parse(comment: str | None, known: Sequence[str], namespaces: Sequence[str] = NAMESPACES) -> tuple[str, list[str], str | None] | None:
    """(verb, rules in order of their names, reason) of one comment, or None."""
    text = (comment or "").removeprefix("//").removeprefix("/*").removesuffix("*/").strip(BLANKS)
    space = next((n for n in namespaces if text.startswith(f"@{n}")), None)
    if space is None:
        return None
    head, mark, reason = text[1 + len(space) :].partition("--")
    words = head.replace("\t", " ").split(" ")
    verb, *rest = [w for w in words if w] or [""]
    if verb not in VERBS:
        return None
    named = [name for word in rest for name in word.split(",") if name]
    rules = sorted(set(named) & set(known)) if named and "all" not in named else []
    if named and "all" not in named and not rules:
        return None
    return verb, rules, reason.strip(BLANKS) if mark else None


@F.udtf(returnType="kind string, rules array<string>, reason string")
class Directive:
    """directive(comment, rules, namespaces): no row or one."""

    def eval(self, comment: str, known: list, namespaces: list) -> Iterator[tuple]:
        found = parse(comment, known, namespaces)
        if found is not None:
            yield found


def directives_of(comments: DataFrame, comment: str, rules: Sequence[str], namespaces: Sequence[str] = NAMESPACES) -> DataFrame:
    """comments with kind, rules and reason, joined laterally with the table function; those that are none go."""
    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    call: Column = Directive(F.col(comment).outer(), names(rules), names(namespaces))
    return comments.lateralJoin(call)
