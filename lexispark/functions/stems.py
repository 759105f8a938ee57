"""Dictionary-form candidates of inflected words: rules as data, candidates as one array expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Last character of a polite or negative stem and the dictionary endings it can stand for.
POLITE_ENDINGS = {"き": "く", "ぎ": "ぐ", "ち": "つ", "し": "す", "び": "ぶ", "み": "む", "に": "ぬ", "り": ("る", "う")}
NEGATIVE_ENDINGS = {"か": "く", "が": "ぐ", "た": "つ", "さ": "す", "ば": "ぶ", "ま": "む", "な": "ぬ", "ら": ("る", "う")}
# Suffix, characters cut off, endings put in their place ("" keeps the bare stem), table for the stem's last character.
JA_RULES = (
    ("ました", 3, ("",), POLITE_ENDINGS, ()),
    ("ません", 3, ("",), POLITE_ENDINGS, ()),
    ("ます", 2, ("",), POLITE_ENDINGS, ()),
    ("たい", 2, ("る", "う"), {}, ()),
    ("ない", 2, ("",), NEGATIVE_ENDINGS, ("る", "う")),
    ("な", 1, ("",), {}, ()),
    ("かった", 3, ("",), {}, ()),
    ("ている", 3, ("う", "る"), {}, ()),
    ("られる", 4, ("る",), {}, ()),
    ("える", 2, ("る",), {}, ()),
    ("させる", 3, ("す",), {}, ()),
    ("て", 1, ("う", "る", "つ", "く", "ぐ"), {}, ()),
)
# The same kind of rules for Latin words of the synthetic languages.
LATIN_RULES = (
    ("tion", 4, ("", "te"), {}, ()),
    ("ing", 3, ("", "e"), {}, ()),
    ("ed", 2, ("", "e"), {}, ()),
    ("ly", 2, ("",), {}, ()),
    ("es", 2, ("", "e"), {}, ()),
    ("en", 2, ("", "e"), {}, ()),
    ("er", 2, ("",), {}, ()),
)


def stem_candidates(word: Column, rules=JA_RULES) -> Column:
    """The word itself, then what each rule in order makes of it, each once."""
    none = F.array().cast("array<string>")
    parts = [F.array(word)]
    for suffix, cut, endings, table, more in rules:
        stem = F.left(word, F.length(word) - cut)
        body, last = F.left(stem, F.length(stem) - 1), F.right(stem, F.lit(1))
        made = [F.concat(stem, F.lit(e)) for e in endings]
        swapped = none
        for character, into in table.items():
            swapped = F.when(last == character, F.array(*[F.concat(body, F.lit(e)) for e in into])).otherwise(swapped)
        applies = word.endswith(suffix) & (F.length(word) >= 2) & (F.length(word) >= cut)
        if suffix == "な":
            applies = applies & (F.length(word) > 2)
        if suffix == "ない":
            applies = applies & (F.length(word) > cut)
        rest = [F.concat(stem, F.lit(e)) for e in more]
        parts.append(F.when(applies, F.concat(F.array(*made), swapped, F.array(*rest) if rest else none)).otherwise(none))
    return F.array_distinct(F.concat(*parts))
