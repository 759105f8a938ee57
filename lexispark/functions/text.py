"""Scalar predicates and classes over texts and tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.profiles import ScriptProfile


def validate_text(text: Column, profile: ScriptProfile, limit: int = 50_000) -> Column:
    """Null if a text can be processed, else why not: missing, too_long or no_target_script."""
    missing = text.isNull() | (text == "")
    return F.when(missing, "missing").when(F.length(text) > limit, "too_long").when(~text.rlike(profile.target), "no_target_script")


def token_is_noise(token: Column, profile: ScriptProfile) -> Column:
    return (F.trim(token) == "") | token.rlike(profile.noise)


def token_class(token: Column, profile: ScriptProfile) -> Column:
    """whitespace, particle, punctuation, single or kept, the first that holds."""
    return (
        F.when(token.rlike(r"^[\s　]*$"), "whitespace")
        .when(token.isin(*profile.particles), "particle")
        .when(token.rlike(profile.noise), "punctuation")
        .when(token.rlike(profile.single), "single")
        .otherwise("kept")
    )


def script_class(word: Column, profile: ScriptProfile) -> Column:
    return (
        F.when(word.rlike(profile.katakana_word), "katakana")
        .when(word.rlike(profile.kana_word), "hiragana")
        .when(word.rlike(profile.kanji) & (F.length(word) <= 2), "kanji")
        .when(F.length(word) > 2, "compound")
        .otherwise("other")
    )


def missing_word_type(word: Column, profile: ScriptProfile, endings: tuple[str, ...] = ("う", "る", "い")) -> Column:
    """Why a word may be missing: doubled syllable, stem-like ending, simple script, complex characters."""
    ending = F.lit(False)
    for e in endings:
        ending = ending | word.endswith(e)
    return (
        F.when(word.rlike(r"(\p{L})\1"), "onomatopoeia")
        .when(ending, "stem")
        .when(word.rlike(profile.kana_word), "hiragana")
        .when(word.rlike(profile.kanji), "kanji")
        .otherwise("unknown")
    )


def furigana_flag(surface: Column, reading: Column, profile: ScriptProfile) -> Column:
    return surface.rlike(profile.kanji) & (reading != surface)


def comprehension_band(percent: Column) -> Column:
    return F.when(percent >= 90, "green").when(percent >= 70, "yellow").otherwise("red")


def slugify(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_matches(title: Column, query: str) -> Column:
    return F.contains(F.lower(title), F.lit(query.strip().lower()))


def is_stale(fetched: Column, now: Column, hours: int = 24) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(fetched) > hours * 3600


def filter_health(percent: Column) -> Column:
    return F.when(percent > 50, "warn").when(percent > 35, "reasonable").otherwise("good")


def percent(part: Column, whole: Column) -> Column:
    """Half-up whole percent, null for an empty whole."""
    return F.floor(F.try_divide(part * F.lit(100.0), whole) + 0.5)
