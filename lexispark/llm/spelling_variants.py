"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols. Every word generates the full one-edit neighbourhood of its reduced word (itself, deletions,
replacements and insertions of symbols) as 64-bit keys, which are joined with the reduced vocabulary; what meets is verified on the
original strings. Two words one edit apart reduce to equal words or to words one edit apart, so none is missed. The number of symbols
follows the vocabulary: as many as give the shortest words at least as many reduced forms as there are such words, so what
meets by chance stays in proportion to the words.

Words are counted in one aggregation that combines before the shuffle; all later steps work on the vocabulary.

Defined results: null texts have no words, a null doc_id is written as nothing in the hash that chooses deletions; repeated rows count as often as they
occur; words shorter than the least length or rarer than the least count are left out, as neighbours too; a table without such words
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import ascii_lower, discard, partitions, written

# The letters of a word, and those whose lower case is left alone.
LETTERS, KEPT_CAPITALS = r"A-Za-zÀ-ÿ", r"[À-Þ]"
#: Fewest and most symbols of the reduced alphabet.
SYMBOLS = (3, 16)


def lowered(run: Column) -> Column:
    """A-Z of a run in lower case: lower() alone, but for runs with accented capitals, which stay."""
    return F.when(run.rlike(KEPT_CAPITALS), ascii_lower(run)).otherwise(F.lower(run))


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """run without one letter where `every` divides its hash."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, without).otherwise(run)


def word_counts(docs: DataFrame, shortest: int, least: int, every: int) -> DataFrame:
    """docs (doc_id, text) -> word, n. Runs below the least length can't become words."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("_run")).select("doc_id", lowered(F.col("_run")).alias("_run"))
    words = rows.select(damaged(F.col("doc_id"), F.col("_run"), every).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def symbols_for(words: DataFrame, shortest: int) -> int:
    """Symbols of the reduced alphabet: their power of the least length reaches the number of words of about that length."""
    short = words.where(F.length("word") <= shortest + 1).count()
    return min(max(SYMBOLS[0], round(short ** (1 / shortest) + 0.5)), SYMBOLS[1])


def reduced(word: Column, symbols: int) -> Column:
    """Each letter as one of a few symbols, by its code point."""
    capitals = "".join(map(chr, range(65, 91)))
    letters = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)])) + capitals
    return F.translate(word, letters, "".join(chr(97 + i % symbols) for i in range(len(letters))))


def neighbourhood(r: Column, symbols: int) -> Column:
    """Keys of a reduced word and of all words one edit from it."""
    size, places = F.length(r), F.sequence(F.lit(1), F.length(r))
    alphabet = F.array(*(F.lit(chr(97 + i)) for i in range(symbols)))
    left = lambda i: F.substring(r, F.lit(1), i - 1)
    deleted = F.transform(places, lambda i: F.concat(left(i), F.substring(r, i + 1, size)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(alphabet, lambda s: F.concat(left(i), s, F.substring(r, i + 1, size)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.transform(alphabet, lambda s: F.concat(left(i), s, F.substring(r, i, size)))))
    return F.array_distinct(F.transform(F.concat(F.array(r), deleted, replaced, inserted), lambda x: F.xxhash64(x)))


def near_pairs(words: DataFrame, shortest: int = 6) -> DataFrame:
    """words (word, n) -> word, n, other, other_n: each word with every word exactly one edit away."""
    symbols = symbols_for(words, shortest)
    r = reduced(F.col("word"), symbols)
    # the vocabulary is small beside its neighbourhoods, so it is dealt out before they are made
    dealt = words.select("word", "n").repartition(partitions(words.sparkSession), "word")
    asking = dealt.select("word", "n", F.explode(neighbourhood(r, symbols)).alias("_key"))
    there = words.select(F.xxhash64(r).alias("_of"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = asking.join(there, F.col("_key") == F.col("_of"))
    return met.where((F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: forms followed to the last, each round twice as far. A form is more frequent than its word by a
    factor, so chains are short and end."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = known.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        further = written(known.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(known)
        known = further.select("word", "root")
        if not further.where("_moved").limit(1).count():
            return known


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, every: int = 199) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n."""
    words = written(word_counts(docs, shortest, least, every), "words")
    # of the near words the most frequent, and the first of equal ones
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = near_pairs(words, shortest).groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    rows = words.join(near, F.col("word") == F.col("_word"), "left")
    enough = -F.col("_best.m") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("_best.form")).alias("form"), F.when(enough, -F.col("_best.m")).alias("form_n"))
    rows = written(rows, "variants")
    last = roots(rows.where("form IS NOT NULL"))
    rows = rows.join(last.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
