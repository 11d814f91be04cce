"""Calls and statements of scripts that go over several lines, by patterns over whole texts.

Brackets nest up to ``DEPTH``; strings and templates count as a whole, so a bracket or comma in them is none. All
repetition is possessive: a text of any length is read once, without recursion over its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, running_sums

DEPTH = 10
STRING = "\"(?:[^\"\\\\]|\\\\.)*+\"|'(?:[^'\\\\]|\\\\.)*+'|`(?:[^`\\\\]|\\\\.)*+`"
#: Stands for a line break within a call; white space to every pattern.
BREAK = "\x0b"


def nested(functions: bool = True, depth: int = DEPTH) -> str:
    """What may stand between two brackets; without ``functions``, no arrow and so no body of one."""
    atom = f"{STRING}|[^()\\[\\]{{}}\"'`]" if functions else f"{STRING}|[^()\\[\\]{{}}\"'`=]|=(?!>)"
    inside = f"(?:{atom})*+"
    for _ in range(depth):
        inside = f"(?:{atom}|[(\\[{{]{inside}[)\\]}}])*+"
    return inside


def first_argument(depth: int = DEPTH) -> str:
    """What stands up to the first comma or closing bracket of its own level."""
    return f"(?:{STRING}|[^,()\\[\\]{{}}\"'`]|[(\\[{{]{nested(depth=depth)}[)\\]}}]|[\"'`])*+"


def replaced(text: Column, pattern: str, change) -> Column:
    """The text with ``change`` (a function of a Column) applied to each match."""

    def parts(t: Column) -> Column:
        found = F.concat(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        return F.zip_with(F.split(t, pattern, -1), found, lambda gap, match: F.concat(gap, F.coalesce(change(match), F.lit(""))))

    return bound(text, lambda t: F.when(t.rlike(pattern), F.array_join(parts(t), "")).otherwise(t))


def joined(text: Column, calls: str) -> Column:
    """A text in which every call is one line: breaks within the brackets of ``calls`` (a pattern that ends with the
    opening bracket), behind an assignment and before a chained call become ``BREAK``.

    A call with a function among its arguments stays as it is, for that function's statements are lines.
    """
    t = F.translate(F.regexp_replace(text, "\r\n?", "\n"), BREAK, " ")
    t = F.regexp_replace(t, "(?<=[^=!<>]=)[ \t]*\n(?=[ \t]*\\S)", BREAK)
    t = F.regexp_replace(t, "\n(?=[ \t]*\\.[A-Za-z_$])", BREAK)
    return replaced(t, f"(?:{calls}){nested(functions=False)}\\)", lambda m: F.translate(m, "\n", BREAK))


def numbered(text: Column) -> Column:
    """Lines of a joined text as structs: raw, and n, the number of the first line it stands on."""
    def each(lines: Column) -> Column:
        begins = running_sums(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(lines, lambda x: (F.length(x) - F.length(F.translate(x, BREAK, "")) + 1).cast("bigint"))), 1)
        return F.zip_with(lines, F.slice(begins, F.lit(1), F.size(lines)), lambda x, n: F.struct(x.alias("raw"), n.cast("int").alias("n")))

    return bound(F.split(text, "\n"), each)


def shown(line: Column) -> Column:
    """A line as evidence."""
    return F.trim(F.regexp_replace(line, f"[ \t]*{BREAK}[ \t]*", " "))


