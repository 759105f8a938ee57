"""Scalar rules on small tables."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import scoring as S
from lexispark.functions import stems
from lexispark.functions import text as T
from lexispark.functions.profiles import JA, LATIN

FREQUENCY = [
    (None, "は", -20), (None, "食べる", 50), (["news1"], "x", -20), (["ichi1"], "x", -20), (["news2"], "x", -10), (["ichi2"], "x", -10),
    (["gai1"], "x", 0), (["spec1", "nf01"], "x", 0), (["gai2"], "x", 5), (["spec2"], "x", 5), (["nf05"], "x", 10), (["nf06"], "x", 15),
    (["nf10"], "x", 15), (["nf20"], "x", 20), (["nf30"], "x", 30), (["nf31"], "x", 40), ([], "x", 50), (["other"], "x", 50),
]


def test_freq_penalty(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FREQUENCY)], "i int, p array<string>, w string, want int")
    got = df.select("i", "want", S.freq_penalty(F.col("p"), F.col("w"), "^[ぁ-ん]{1,3}$").alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


@pytest.mark.parametrize(("level", "grade", "frequency", "want"), [(5, 1, -20, 1), (0, 9, 50, 100), (4, 3, 0, 40), (1, 8, -20, 95), (7, 0, 0, 100)])
def test_word_score(spark, level, grade, frequency, want):
    row = spark.range(1).select(S.word_score(F.lit(level), F.lit(grade), F.lit(frequency)).alias("s")).first()
    assert row.s == want


def test_srs_adjust_can_be_applied_again(spark):
    df = spark.createDataFrame([(40, None, 7), (40, None, None), (1, None, 9), (10, 40, 7)], "score int, base int, stage int")
    got = [r.s for r in df.select(S.srs_adjust(F.col("score"), F.col("base"), F.col("stage")).alias("s")).collect()]
    assert got == [10, 40, 1, 10]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("書きました", ["書きました", "書き", "書く"]),
        ("売ります", ["売ります", "売り", "売る", "売う"]),
        ("食べない", ["食べない", "食べ", "食べる", "食べう"]),
        ("静かな", ["静かな", "静か"]),
        ("高かった", ["高かった", "高"]),
        ("見ている", ["見ている", "見う", "見る"]),
        ("食べられる", ["食べられる", "食る"]),
        ("な", ["な"]),
    ],
)
def test_stems(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(stems.stem_candidates(F.col("w")).alias("s")).first().s == want


def test_token_classes(spark):
    rows = [("　", "whitespace"), ("は", "particle"), ("。", "punctuation"), ("ね", "single"), ("猫", "kept"), ("ABC", "punctuation")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r for r in df.select("t", "want", T.token_class(F.col("t"), JA).alias("got")).collect() if r.got != r.want] == []


def test_validate_text(spark):
    rows = [(None, "missing"), ("", "missing"), ("日" * 11, "too_long"), ("abc", "no_target_script"), ("猫", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r for r in df.select("t", "want", T.validate_text(F.col("t"), JA, 10).alias("got")).collect() if r.got != r.want] == []


def test_missing_word_type_and_script(spark):
    rows = [("ドキドキ", "unknown"), ("ささ", "onomatopoeia"), ("食べる", "stem"), ("ねこ", "hiragana"), ("猫", "kanji")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r for r in df.select("t", "want", T.missing_word_type(F.col("t"), JA).alias("got")).collect() if r.got != r.want] == []
    assert [r.c for r in spark.createDataFrame([("été",), ("the",), ("é",)], "w string").select(T.script_class(F.col("w"), LATIN).alias("c")).collect()] == ["compound", "hiragana", "kanji"]


def test_dict_meanings(spark):
    senses = [[["rare thing"], ["plain", "second"], ["auxiliary verb"]]]
    row = spark.createDataFrame([(s,) for s in senses], "s array<array<string>>").select(S.dict_meanings(F.col("s")).alias("m")).first()
    assert row.m == ["plain", "second", "auxiliary verb", "rare thing"]
