"""Dictionary forms from an analyzer's part-of-speech slots: a rule table joined to distinct morphemes, the first rule wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Conjugation lines with the endings of their dictionary and volitional forms.
LINES = {
    "カ行": ("く", "こ"), "ガ行": ("ぐ", "ご"), "サ行": ("す", "そ"), "タ行": ("つ", "と"), "ナ行": ("ぬ", "の"), "ハ行": ("ふ", "ほ"),
    "マ行": ("む", "も"), "ヤ行": ("う", "よ"), "ラ行": ("る", "ろ"), "ワ行": ("う", "お"), "ワア行": ("う", "お"),
}
# Lines of lower one-step verbs and the character on which their stems end.
LOWER_LINES = {"ア行": "え", "バ行": "べ", "ダ行": "で", "マ行": "め", "ヤ行": "え", "ラ行": "れ", "ケ行": "け"}
PAST, VOLITIONAL, STEM = ("連用形", "過去形", "過去分詞形"), ("意志形", "推量形", "未然形"), ("連用形", "未然形", "過去形")
SCHEMA = "rule int, tag string, type string, form string, ending string, cut int, added string"


def rules(spark: SparkSession) -> DataFrame:
    """A row for each rule in order: type and form are prefixes ("" fits all), ending is what the surface ends in, cut and added
    make the dictionary form."""
    rows = []

    def rule(tag: str, kind: str, forms: tuple[str, ...], ending: str, cut: int, added: str) -> None:
        for form in forms:
            rows.append((len(rows), tag, kind, form, ending, cut, added))

    for line, (base, _) in LINES.items():
        rule("動詞", f"五段-{line}", PAST, "", 1, base)
    for line, (base, volitional) in LINES.items():
        rule("動詞", f"五段-{line}", VOLITIONAL, volitional, 1, base)
    for line, ending in LOWER_LINES.items():
        rule("動詞", f"下一段-{line}", STEM, ending, 0, "る")
    rule("動詞", "下一段-", ("",), "け", 0, "る")
    rule("動詞", "上一段-エ行", ("連用形", "未然形"), "い", 1, "える")
    rule("動詞", "上一段-イ行", ("連用形", "未然形"), "い", 1, "いる")
    rule("動詞", "サ行変格", ("連用形-一般", "過去"), "し", 1, "する")
    rule("動詞", "サ行変格", ("未然形-一般",), "せ", 1, "する")
    rule("動詞", "カ行変格", ("連用形-一般", "過去"), "き", 1, "る")
    rule("動詞", "カ行変格", ("未然形-一般",), "こ", 1, "くる")
    for surface in ("ます", "まし", "ませ"):
        rule("助動詞", "助動詞-マス", ("",), surface, 2, "ます")
    for volitional, base in {v: b for b, v in LINES.values()}.items():
        rule("動詞", "", ("",), volitional, 1, base)
    return spark.createDataFrame(rows, SCHEMA)


def pos_base_form(morphemes: DataFrame) -> DataFrame:
    """morphemes (surface, pos_tags: six slots) -> surface, pos_tags, base_form, one row for each distinct pair; without a rule the surface."""
    tag = lambda i: F.coalesce(F.get("pos_tags", F.lit(i)), F.lit(""))
    rows = morphemes.select("surface", "pos_tags").distinct().select("surface", "pos_tags", tag(0).alias("_t"), tag(4).alias("_k"), tag(5).alias("_f"))
    table = F.broadcast(rules(morphemes.sparkSession))  # about a hundred fixed rows
    fits = (F.col("_t") == F.col("tag")) & F.startswith("_k", "type") & F.startswith("_f", "form") & F.endswith("surface", "ending")
    made = F.concat(F.left(F.col("surface"), F.length("surface") - F.col("cut")), F.col("added"))
    found = rows.join(table, fits, "left").withColumn("_made", made)
    return found.groupBy("surface", "pos_tags").agg(F.coalesce(F.min_by("_made", "rule"), F.col("surface")).alias("base_form"))
