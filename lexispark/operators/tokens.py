"""Texts to tokens and what is computed on token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.functions.profiles import ACCENTS, PLAIN, ScriptProfile
from lexispark.operators.places import token_places
from lexispark.operators.trie import lexicon_tokens


def base_form(surface: Column) -> Column:
    """Accents removed, the Latin stand-in for a dictionary form."""
    return F.translate(surface, ACCENTS, PLAIN)


def tokenize(content: DataFrame, profile: ScriptProfile, method: str = "script_run", lexicon: DataFrame | list[str] | None = None) -> DataFrame:
    """content (content_id, text) -> content_id, pos, surface, base_form, in order of the text.

    script_run takes runs of one script by a native expression; lexicon takes the longest word of a table (word[, base_form]) or list,
    else one character, without white space."""
    text = F.lower("text") if profile.lower else F.col("text")
    if method == "lexicon":
        if not isinstance(lexicon, DataFrame):
            lexicon = content.sparkSession.createDataFrame([(w,) for w in lexicon or []], "word string")
        return lexicon_tokens(content, text, lexicon)
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(profile.token), F.lit(0))
    rows = content.select("content_id", F.posexplode(runs).alias("pos", "surface"))
    return rows.withColumn("base_form", base_form(F.col("surface")) if profile.lower else F.col("surface"))


def tokens_from_morphemes(morphemes: DataFrame) -> DataFrame:
    """An analyzer's table (content_id, pos, surface, pos_tags, normalized_form) -> tokens, without supplementary symbols and space."""
    kept = morphemes.where((F.coalesce(F.get("pos_tags", F.lit(0)), F.lit("")) != "補助記号") & ~F.col("surface").rlike(r"^[\s　]+$"))
    return kept.select("content_id", "pos", "surface", F.coalesce(F.nullif("normalized_form", F.lit("")), "surface").alias("base_form"))


def compound_merge(morphemes: DataFrame) -> DataFrame:
    """Prefixes, a main word and suffixes become one word: (content_id, pos, surface, role) -> content_id, word_no, word, n_parts.

    role is prefix, suffix, skip (particles and punctuation) or anything else for a main word."""
    order = W.partitionBy("content_id").orderBy("pos")
    before = F.lag("role").over(order)
    starts = (F.col("role") == "skip") | (F.coalesce(before, F.lit("skip")) == "skip") | ((F.col("role") != "suffix") & (before != "prefix"))
    words = morphemes.withColumn("_start", starts.cast("int"))
    words = words.withColumn("word_no", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    grouped = words.where("role <> 'skip'").groupBy("content_id", "word_no").agg(F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("_p"))
    return grouped.select("content_id", "word_no", F.array_join(F.transform("_p", lambda p: p["surface"]), "").alias("word"), F.size("_p").alias("n_parts"))


def token_offsets(content: DataFrame, tokens: DataFrame) -> DataFrame:
    """Start and end of each token in its text, searched forward from the end of the one before; tokens not found go, and so do null
    tokens and tokens of absent texts. An empty token lies where the search stands.

    The search is sequential within a text, so a text's tokens meet in one row. Script runs of a text are found without that by
    places.run_places."""
    lists = tokens.where("surface IS NOT NULL").groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "surface"))).alias("tokens"))
    rows = content.select("content_id", "text").where("text IS NOT NULL").join(lists, "content_id")
    return token_places(rows.select("content_id", "text", "tokens")).drop("line_no")


def content_lines(content: DataFrame) -> DataFrame:
    """Non-blank lines with their code-point range: content_id, line_no, line_start, line_end."""
    rows = content.select("content_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    order = W.partitionBy("content_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)))
    return rows.where(F.col("line").rlike(r"[^\s　]")).select("content_id", "line_no", "line_start", (F.col("line_start") + F.length("line")).alias("line_end"))


def line_tokens(content: DataFrame, positioned: DataFrame) -> DataFrame:
    """Each positioned token with the line that holds it: tokens and lines of a text in one order, the last line before each token."""
    columns = positioned.columns
    lines = content_lines(content).select("content_id", F.col("line_start").cast("int").alias("_at"), F.struct("line_no", "line_start", "line_end").alias("_line"), F.lit(None).cast(positioned.select(F.struct(*columns).alias("t")).schema["t"].dataType).alias("_token"))
    rows = positioned.select("content_id", F.col("start_idx").alias("_at"), F.lit(None).cast(lines.schema["_line"].dataType).alias("_line"), F.struct(*columns).alias("_token"))
    order = W.partitionBy("content_id").orderBy("_at", F.col("_token").isNotNull())
    rows = rows.unionByName(lines).withColumn("_line", F.last("_line", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where("_token IS NOT NULL AND _token.end_idx <= _line.line_end").select("_token.*", "_line.*")


def classified(tokens: DataFrame, profile: ScriptProfile) -> DataFrame:
    return tokens.withColumn("token_class", T.token_class(F.col("surface"), profile))


def token_flags(tokens: DataFrame, morphemes: DataFrame, profile: ScriptProfile) -> DataFrame:
    """is_vocab_word: neither noise nor a single letter; is_morpheme: a single letter that has a definition."""
    defined = F.broadcast(morphemes.select(F.col("morpheme").alias("_m"), "definition"))  # a fixed table of some dozens of rows
    surface = F.col("surface")
    rows = tokens.join(defined, surface == F.col("_m"), "left").drop("_m")
    single = surface.rlike(profile.single)
    return rows.withColumn("is_vocab_word", ~T.token_is_noise(surface, profile) & ~single).withColumn("is_morpheme", single & F.col("definition").isNotNull())
