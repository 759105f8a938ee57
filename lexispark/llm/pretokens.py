"""Splitting texts into the pieces on which byte-level BPE merges work, by JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space in Unicode (Java's \s has ASCII only).
UNICODE_SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    """The public pattern with its white-space classes spelled out for Java."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            negated = "^" if two == r"\S" else ""
            out.append(UNICODE_SPACE if inside and not negated else f"[{negated}{UNICODE_SPACE}]")
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(two)
            i += 2
            continue
        inside = {"[": True, "]": False}.get(pattern[i], inside)
        out.append(pattern[i])
        i += 1
    return "".join(out)


def pretokens(text: Column, pattern: str) -> Column:
    """All matches of the pattern in order; together they are the whole text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
