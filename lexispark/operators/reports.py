"""Reports on token filtering, dictionary coverage and critical words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.functions.profiles import ScriptProfile
from lexispark.operators.tokens import classified


def filter_stats(tokens: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Tokens, filtered and kept tokens and the filtered percent, per content and in all (content_id null)."""
    dropped = T.token_is_noise(F.col("surface"), profile) | F.col("surface").isin(*profile.particles) | F.col("surface").rlike(profile.single)
    rows = tokens.select("content_id", dropped.cast("int").alias("_d"))
    per = rows.rollup("content_id").agg(F.count(F.lit(1)).alias("total"), F.sum("_d").alias("filtered"), F.grouping("content_id").alias("is_total"))
    return per.withColumn("kept", F.col("total") - F.col("filtered")).withColumn("filtered_percent", T.percent(F.col("filtered"), F.col("total")))


def filtered_tokens(tokens: DataFrame, profile: ScriptProfile) -> DataFrame:
    return classified(tokens, profile).where("token_class <> 'kept'").groupBy("token_class", "surface").agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, content: DataFrame | None = None, of_nothing: int | None = None) -> DataFrame:
    """rows (content_id, found, weight) -> words with and without definition and accuracy, per content and in all.

    With content (content_id) texts without words have a row too; of_nothing is the accuracy where there are no words."""
    per = rows.rollup("content_id").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("found"), F.col("weight")).otherwise(0)).alias("with_definition"), F.grouping("content_id").alias("is_total"))
    if content is not None:
        counted = per.select(F.col("content_id").alias("_c"), "total", "with_definition").where("is_total = 0")
        each = content.select("content_id").join(counted, F.col("content_id").eqNullSafe(F.col("_c")), "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        each = each.select("content_id", zero("total"), zero("with_definition"), F.lit(0).cast("tinyint").alias("is_total"))
        per = each.unionByName(per.where("is_total = 1").select("content_id", zero("total"), zero("with_definition"), "is_total"))
    accuracy = F.coalesce(T.percent(F.col("with_definition"), F.col("total")), F.lit(of_nothing))
    return per.withColumn("without_definition", F.col("total") - F.col("with_definition")).withColumn("accuracy", accuracy)


def looked_up(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """counts (content_id, word, base_form, frequency) with found: the lexicon has the word or its base form. Keys are joined as distinct words."""
    keys = lexicon.select(F.col("written").alias("k")).union(lexicon.select("pronounced")).distinct()
    words = counts.select("word", "base_form").distinct()
    hits = words.join(keys, F.col("word") == F.col("k"), "left_semi").union(words.join(keys, F.col("base_form") == F.col("k"), "left_semi")).distinct()
    return counts.join(hits.withColumn("_hit", F.lit(True)), ["word", "base_form"], "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def coverage_unique(counts: DataFrame, lexicon: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Coverage of each text's distinct words; null accuracy without words."""
    return coverage(looked_up(counts, lexicon).select("content_id", "found", F.lit(1).alias("weight")), content)


def coverage_occurrence(counts: DataFrame, lexicon: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Coverage of all word occurrences; 100 without words."""
    return coverage(looked_up(counts, lexicon).select("content_id", "found", F.col("frequency").alias("weight")), content, 100)


def missing_words(counts: DataFrame, lexicon: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Missing base forms with their occurrences, type and up to three surfaces in order.

    Each partition passes on three surfaces of a base form at most, so a frequent one is never gathered whole."""
    missing = looked_up(counts, lexicon).where("NOT found").groupBy("base_form", "word").agg(F.sum("frequency").alias("n"), F.min(F.struct("content_id", "ord")).alias("_o"))
    order = W.partitionBy("base_form").orderBy("_o", "word")
    heads = missing.select("base_form", "word", "_o").withColumn("_n", F.row_number().over(order)).where("_n <= 3")
    heads = heads.groupBy("base_form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda s: s["word"]), ",").alias("surfaces"))
    per = missing.groupBy("base_form").agg(F.sum("n").alias("n")).join(heads, "base_form")
    return per.select("base_form", "n", "surfaces", T.missing_word_type(F.col("base_form"), profile).alias("type"))


def missing_counts(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """missing_words without types and surfaces: base_form, n. Words are added up over all texts before they are looked up."""
    words = counts.groupBy("word", "base_form").agg(F.sum("frequency").alias("frequency"))
    return looked_up(words, lexicon).where("NOT found").groupBy("base_form").agg(F.sum("frequency").alias("n"))


def missing_by_script(counts: DataFrame, lexicon: DataFrame, profile: ScriptProfile) -> DataFrame:
    words = looked_up(counts, lexicon).where("NOT found").select("word").distinct()
    return words.groupBy(T.script_class(F.col("word"), profile).alias("script")).agg(F.count(F.lit(1)).alias("n_words"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


def worst_coverage(coverage_rows: DataFrame, n: int = 5) -> DataFrame:
    return coverage_rows.where("is_total = 0").orderBy(F.col("accuracy").asc_nulls_last(), "content_id").limit(n)


def top_filtered(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.where("is_total = 0").orderBy(F.col("filtered_percent").desc_nulls_last(), "content_id").limit(n)


def top_missing(missing: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent missing words and how many more there are."""
    more = missing.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("n_more"))
    top = missing.orderBy(F.col("n").desc(), "base_form").limit(n).select("base_form", "n")
    return top.join(F.broadcast(more))  # one row


def critical_word_check(tokens: DataFrame, expected: DataFrame) -> DataFrame:
    """tokens (method, surface) against expected (word): words found by each method, of how many, and the percent."""
    seen = tokens.join(expected.select(F.col("word").alias("surface")), "surface", "left_semi").select("method", "surface").distinct()
    total = expected.select("word").distinct().agg(F.count(F.lit(1)).alias("expected"))
    return seen.groupBy("method").agg(F.count(F.lit(1)).alias("found")).join(F.broadcast(total)).withColumn("percent", T.percent(F.col("found"), F.col("expected")))
