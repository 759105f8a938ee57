"""Word scores: level, grade and frequency parts, spaced-repetition multipliers, commonness of dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score of a level, penalty of a school grade, multiplier and name of a repetition stage.
LEVEL_SCORES = {5: 15, 4: 30, 3: 50, 2: 70, 1: 90, 0: 100}
GRADE_PENALTIES = {1: 5, 2: 7, 3: 10, 4: 12, 5: 15, 6: 20, 8: 25, 9: 30}
STAGE_MULTIPLIERS = {1: 0.95, 2: 0.90, 3: 0.80, 4: 0.70, 5: 0.50, 6: 0.35, 7: 0.25, 8: 0.15, 9: 0.05}
KNOWN_STAGE = 7
# Words that mark a specialised or a grammatical sense.
SPECIAL_TERMS = ("esp.", "rare", "archaic", "obsolete", "old", "dated", "specialized")
GRAMMAR_TERMS = ("copula", "auxiliary")


def choose(key: Column, table: dict, default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def level_score(level: Column) -> Column:
    return choose(level, LEVEL_SCORES, F.lit(100))


def grade_penalty(grade: Column) -> Column:
    return choose(grade, GRADE_PENALTIES, F.lit(0))


# Frequency tags with their penalties, the first that a word has counts; then the highest rank of a band, after nf,
# with its penalty.
TAG_PENALTIES = (("news1", -20), ("ichi1", -20), ("news2", -10), ("ichi2", -10), ("gai1", 0), ("spec1", 0), ("gai2", 5), ("spec2", 5))
BAND_PENALTIES = ((5, 10), (10, 15), (20, 20), (30, 30))
OTHER_BAND, NO_TAG, SHORT_KANA = 40, 50, -20


def freq_penalty(priorities: Column, word: Column, short_kana: str) -> Column:
    """Penalty by frequency tags; priorities is null where a word has no variant, and short function words then get a bonus."""
    band = F.get(F.filter(priorities, lambda p: p.startswith("nf")), F.lit(0))
    rank = F.regexp_extract(F.coalesce(band, F.lit("")), r"^nf(\d+)", 1).try_cast("int")  # absurd ranks have none
    by_band = F.when(band.isNull(), NO_TAG)
    for last, penalty in BAND_PENALTIES:
        by_band = by_band.when(rank <= last, penalty)
    by_tag = F.when(priorities.isNull() & word.rlike(short_kana), SHORT_KANA)
    for tag, penalty in TAG_PENALTIES:
        by_tag = by_tag.when(F.array_contains(priorities, tag), penalty)
    return by_tag.otherwise(by_band.otherwise(OTHER_BAND))


def word_score(level: Column, grade: Column, frequency: Column) -> Column:
    """1 to 100: level score, grade penalty and frequency penalty together."""
    return F.greatest(F.lit(1), F.least(F.lit(100), level_score(level) + grade_penalty(grade) + frequency))


def variant_score(word: Column, written: Column, priorities: Column, entry_pos: Column, kana_word: str, kanji: str) -> Column:
    """How well a dictionary variant fits a word that it is written or pronounced like."""
    tagged = F.size(F.coalesce(priorities, F.array().cast("array<string>"))) > 0
    has = lambda *tags: F.coalesce(F.arrays_overlap(priorities, F.array(*[F.lit(t) for t in tags])), F.lit(False))
    exact = F.when(written == word, 100).otherwise(0) + F.when(tagged, 50).otherwise(0)
    foreign = (written != word) & word.rlike(kana_word) & written.rlike(kanji)
    penalty = F.when(foreign & tagged, -20).when(foreign, -200).otherwise(0)
    common = F.when(has("ichi1", "news1"), 1000).when(has("ichi2", "news2"), 500).otherwise(0)
    return exact + penalty + common + F.greatest(F.lit(0), 50 - entry_pos)


def stage_multiplier(stage: Column) -> Column:
    return choose(stage, STAGE_MULTIPLIERS, F.lit(1.0))


def srs_adjust(score: Column, base_score: Column, stage: Column) -> Column:
    """Score by repetition stage, always from the base score, so it can be applied again."""
    base = F.coalesce(base_score, score)
    return F.when(stage.isNull(), base).otherwise(F.greatest(F.lit(1), F.floor(base * stage_multiplier(stage) + 0.5).cast("int")))


def entry_commonness(n_kanji: Column, n_senses: Column) -> Column:
    return F.when(n_kanji > 0, 10).otherwise(0) + F.when(n_kanji > 1, 5).otherwise(0) + F.when(n_senses > 1, 3).otherwise(0)


def sense_commonness(glosses: Column) -> Column:
    """By the glosses of a sense: several, specialised, grammatical."""
    first = F.lower(F.coalesce(F.get(glosses, F.lit(0)), F.lit("")))
    some = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(first, t))
    return F.when(F.size(glosses) > 1, 5).otherwise(0) - F.when(some(SPECIAL_TERMS), 10).otherwise(0) + F.when(some(GRAMMAR_TERMS), 3).otherwise(0)


def dict_meanings(senses: Column) -> Column:
    """senses: array of gloss arrays -> all glosses, common senses first, ties in order."""
    ranked = F.array_sort(F.transform(senses, lambda g, i: F.struct((-sense_commonness(g)).alias("rank"), i.alias("i"), g.alias("g"))))
    return F.flatten(F.transform(ranked, lambda s: s["g"]))
