"""Dictionary lookups as joins: exact, with fallbacks, by tiers; best variants, best entries, meanings.

Lookups run over distinct words, never over tokens. A lexicon is a table of variants: entry_id, entry_pos, variant_pos, written,
pronounced, priorities and gloss. An OR of two keys is a union of two equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import scoring as S
from lexispark.functions import stems
from lexispark.functions.profiles import ScriptProfile
from lexispark.sources.char_index import CharIndex


def dict_lookup_exact(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word) -> a row for each variant that is written or pronounced like the word."""
    variants = lexicon.select("entry_id", "entry_pos", "variant_pos", "written", "pronounced", "priorities", "gloss")
    by_written = words.join(variants, F.col("word") == F.col("written"))
    by_reading = words.join(variants.where("written <> pronounced"), F.col("word") == F.col("pronounced"))
    return by_written.unionByName(by_reading)


def lexicon_keys(lexicon: DataFrame) -> DataFrame:
    """dict_lookup_exact of all words that the lexicon has, without a join."""
    keys = F.when(F.col("written") != F.col("pronounced"), F.array("written", "pronounced")).otherwise(F.array("written"))
    rows = lexicon.select(F.explode(keys).alias("word"), "entry_id", "entry_pos", "variant_pos", "written", "pronounced", "priorities", "gloss")
    return rows.where("word IS NOT NULL")


def dict_lookup_fallback(words: DataFrame, lexicon: DataFrame, rules=stems.JA_RULES) -> DataFrame:
    """words (word, base_form) -> word, key, rank: the first of base form, its stems, surface, its stems that the lexicon has.

    Stems are tried only for words of more than two characters."""
    of = lambda c: F.when(F.length(c) > 2, stems.stem_candidates(F.col(c), rules)).otherwise(F.array(c))
    candidates = words.select("word", F.posexplode(F.array_distinct(F.concat(of("base_form"), of("word")))).alias("rank", "key"))
    keys = lexicon.select(F.col("written").alias("key")).union(lexicon.select("pronounced")).distinct()
    found = candidates.join(keys, "key", "left_semi")
    return found.groupBy("word").agg(F.min_by("key", "rank").alias("key"), F.min("rank").alias("rank"))


def stem_lookup(words: DataFrame, lexicon: DataFrame, rules=stems.JA_RULES) -> DataFrame:
    """words (word) -> word, found: the first candidate that the lexicon has, else the word."""
    hits = dict_lookup_fallback(words.select("word", F.col("word").alias("base_form")), lexicon, rules)
    return words.join(hits.select("word", "key"), "word", "left").select("word", F.coalesce("key", "word").alias("found"))


def entry_order(matches: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Adds entry_rank: for simple-script words entries with a simple or equally pronounced variant come first, each group in order."""
    simple = F.col("written").rlike(profile.kana_word) | (F.col("pronounced") == F.col("word"))
    flags = matches.groupBy("word", "entry_id").agg(F.max(simple.cast("int")).alias("_simple"), F.min("entry_pos").alias("entry_pos"))
    first = F.when(F.col("word").rlike(profile.kana_word), F.col("_simple")).otherwise(F.lit(0))
    order = W.partitionBy("word").orderBy(first.desc(), "entry_pos", "entry_id")
    return flags.select("word", "entry_id", (F.row_number().over(order) - 1).alias("entry_rank"))


def best_variant(matches: DataFrame, profile: ScriptProfile) -> DataFrame:
    """The best variant of each word: highest score, ties to the earlier entry and variant; none below 0."""
    score = S.variant_score(F.col("word"), F.col("written"), F.col("priorities"), F.col("entry_pos"), profile.kana_word, profile.kanji)
    # ranking by a packed integer keeps this a hash aggregation instead of a sort by word
    ranked = matches.withColumn("variant_score", score).where("variant_score >= 0")
    best = ranked.groupBy("word").agg(F.max_by(F.struct("entry_id", "written", "pronounced", "priorities", "gloss", "variant_score"), F.struct("variant_score", -F.col("entry_pos"), -F.col("variant_pos"))).alias("_b"))
    return best.select("word", "_b.*")


def reading_then_kanji_lookup(words: DataFrame, lexicon: DataFrame, limit: int = 10) -> DataFrame:
    """Up to limit entries by reading, else up to limit by writing."""
    variants = lexicon.select("entry_id", "entry_pos", "written", "pronounced")
    reading = words.join(variants, F.col("word") == F.col("pronounced")).withColumn("tier", F.lit(1))
    writing = words.join(variants, F.col("word") == F.col("written")).withColumn("tier", F.lit(2))
    hits = reading.unionByName(writing).groupBy("word", "tier", "entry_id").agg(F.min("entry_pos").alias("entry_pos"))
    hits = hits.withColumn("_best", F.min("tier").over(W.partitionBy("word"))).where("tier = _best")
    order = W.partitionBy("word").orderBy("entry_pos", "entry_id")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("word", "tier", "entry_id", "n")


def dict_best_entry(candidates: DataFrame) -> DataFrame:
    """candidates (word, entry_id, pos, exact, n_kanji, n_senses): the first exact entry, else the most common, ties to the first."""
    key = F.struct(F.col("exact").cast("int"), F.when(F.col("exact"), 0).otherwise(S.entry_commonness(F.col("n_kanji"), F.col("n_senses"))), -F.col("pos"))
    return candidates.groupBy("word").agg(F.max_by("entry_id", key).alias("entry_id"))


def first_entry_meaning(matches: DataFrame, profile: ScriptProfile) -> DataFrame:
    """The gloss of the first entry; for simple-script words of the first with a variant of that script or reading."""
    ranked = matches.join(entry_order(matches, profile), ["word", "entry_id"])
    return ranked.groupBy("word").agg(F.min_by("gloss", F.struct("entry_rank", "variant_pos")).alias("meaning"))


def names_index(names: DataFrame) -> DataFrame:
    """names (entry_pos, kana, kanji, meanings) -> one row for each key, the first entry's: by reading, and by writing if it differs."""
    meaning = F.coalesce(F.get("meanings", F.lit(0)), F.lit("Unknown"))
    by_kana = names.select(F.col("kana").alias("key"), "entry_pos", F.lit(0).alias("_o"), meaning.alias("meaning"), F.col("kana").alias("reading"))
    by_kanji = names.where("kanji IS NOT NULL AND kanji <> kana").select(F.col("kanji").alias("key"), "entry_pos", F.lit(1).alias("_o"), meaning.alias("meaning"), F.col("kana").alias("reading"))
    rows = by_kana.unionByName(by_kanji).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.min_by(F.struct("meaning", "reading"), F.struct("entry_pos", "_o")).alias("_f")).select("key", "_f.*")


def dict_chain(words: DataFrame, sources: list[DataFrame], profile: ScriptProfile) -> DataFrame:
    """The first source, in order, that knows a word; the first source (names) counts for simple-script words only.

    Sources have (key, meaning). -> word, meaning, tier."""
    tiers = None
    for tier, source in enumerate(sources):
        one = source.select("key", "meaning", F.lit(tier).alias("tier"))
        tiers = one if tiers is None else tiers.unionByName(one)
    hits = words.select("word").join(tiers, F.col("word") == F.col("key")).where((F.col("tier") > 0) | F.col("word").rlike(profile.kana_word))
    return hits.groupBy("word").agg(F.min_by("meaning", F.struct("tier", "meaning")).alias("meaning"), F.min("tier").alias("tier"))


def kana_override(rows: DataFrame, chain: DataFrame, profile: ScriptProfile, katakana: bool = True) -> DataFrame:
    """rows (word, meaning): simple-script words take the chain's meaning, and a default if there is none at all."""
    simple = F.col("word").rlike(profile.kana_word)
    wide = simple | F.col("word").rlike(profile.katakana_word) if katakana else simple
    joined = rows.join(chain.select("word", F.col("meaning").alias("_chain")), "word", "left")
    meaning = F.when(wide, F.coalesce("_chain", "meaning")).otherwise(F.col("meaning"))
    default = F.when(simple, "Kana particle / expression")
    return joined.withColumn("meaning", F.coalesce(meaning, default, F.lit("Unknown meaning"))).drop("_chain")


def word_chars(words: DataFrame, profile: ScriptProfile) -> DataFrame:
    """word -> a row for each of its complex characters: word, i, ch."""
    return words.select("word", F.posexplode(F.regexp_extract_all("word", F.lit(profile.kanji), F.lit(0))).alias("i", "ch"))


def char_postings(lexicon: DataFrame, profile: ScriptProfile) -> DataFrame:
    """lexicon (entry_id, written) -> ch, entry_id: every entry once for each complex character of its writings."""
    chars = F.array_distinct(F.regexp_extract_all("written", F.lit(profile.kanji), F.lit(0)))
    return lexicon.select(F.explode(chars).alias("ch"), "entry_id").distinct()


def char_entries(words: DataFrame, index: CharIndex, profile: ScriptProfile) -> DataFrame:
    """words (word) -> word, ch, entry_id: all entries that share a complex character with it, by the stored index."""
    return index.entries(word_chars(words, profile).select("word", "ch").distinct())


def related_words(words: DataFrame, profile: ScriptProfile, limit: int = 10, hot: int = 64) -> DataFrame:
    """words (word, ord) -> up to limit other words that share a complex character, first seen first: word, n, related.

    Only a character's first words in order can be among the first of any word, so each character keeps limit + 1 of them: the
    self-join grows with the words, not with the square of a character's words."""
    chars = word_chars(words, profile).select("word", "ch").distinct().join(words.select("word", "ord"), "word")
    salted = W.partitionBy("ch", F.pmod(F.xxhash64("word"), F.lit(hot))).orderBy("ord", "word")
    heads = chars.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= limit + 1)
    heads = heads.withColumn("_n", F.row_number().over(W.partitionBy("ch").orderBy("ord", "word"))).where(F.col("_n") <= limit + 1)
    heads = heads.select(F.col("ch").alias("_ch"), F.col("word").alias("related"), F.col("ord").alias("_ord"))
    pairs = chars.join(heads, (F.col("ch") == F.col("_ch")) & (F.col("word") != F.col("related"))).groupBy("word", "related").agg(F.min("_ord").alias("_ord"))
    order = W.partitionBy("word").orderBy("_ord", "related")
    return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("word", "n", "related")


def dict_compare(words: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Each source's meaning of a word beside the others', and how many found it."""
    out = words.select("word")
    for name, source in sources.items():
        one = source.groupBy("key").agg(F.min("meaning").alias(name))
        out = out.join(one, F.col("word") == F.col("key"), "left").drop("key")
    return out.withColumn("n_found", sum(F.col(name).isNotNull().cast("int") for name in sources))


def dict_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found (word, meaning) against expected (word, expected): right if one contains the other, cut at ( and /."""
    cut = lambda c: F.trim(F.lower(F.regexp_extract(c, r"^([^(/]*)", 1)))
    rows = expected.join(found, "word", "left").withColumn("_e", cut(F.col("expected"))).withColumn("_m", F.lower("meaning"))
    right = F.coalesce(F.contains("_m", "_e") | F.contains("_e", "_m"), F.lit(False))
    return rows.select("word", "expected", "meaning", right.alias("correct"))


def word_detail(words: DataFrame, lexicon: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Best variant, number and text of all distinct glosses in order, for a table of words."""
    matches = dict_lookup_exact(words, lexicon)
    glosses = matches.where("gloss IS NOT NULL").groupBy("word", "gloss").agg(F.min(F.struct("entry_pos", "entry_id")).alias("_o"))
    glosses = glosses.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("_o", "gloss"))).alias("_g"))
    glosses = glosses.select("word", F.array_join(F.transform("_g", lambda g: g["gloss"]), "; ").alias("glosses"), F.size("_g").alias("n_glosses"))
    return best_variant(matches, profile).join(glosses, "word", "left")
