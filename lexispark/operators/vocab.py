"""Vocabulary of texts: distinct words with counts, lookups and scores, and what a learner's known words make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import scoring as S
from lexispark.functions import text as T
from lexispark.functions.profiles import ScriptProfile
from lexispark.operators import lookup
from lexispark.operators.places import run_counts, ungrouped
from lexispark.operators.tokens import base_form


def with_chars(rows: DataFrame, words: DataFrame, char_meta: DataFrame, profile: ScriptProfile) -> DataFrame:
    """rows (word, ...), a row for each word, with what its complex characters come to; words (word) has the same words at less cost."""
    meta = F.broadcast(char_meta.select("ch", "jlpt", "grade"))  # one row for each character of a script
    chars = lookup.word_chars(words, profile).join(meta, "ch", "left")
    grade = F.when(F.col("grade") <= 8, F.col("grade")).otherwise(F.lit(9))
    per = chars.groupBy("word").agg(
        F.min("jlpt").alias("_jlpt"),
        F.max(grade).alias("highest_grade"),
        F.min((F.coalesce(F.col("grade"), F.lit(99)) <= 8).cast("int")).alias("_joyo"),
        F.array_sort(F.collect_list(F.struct("i", F.coalesce("jlpt", F.lit(0)).alias("v")))).alias("_l"),
    )
    level = F.when(F.col("highest_grade").isNull(), 5).otherwise(F.coalesce("_jlpt", F.lit(0)))
    joined = rows.join(per, "word", "left")
    return joined.withColumn("jlpt", level).withColumn("joyo", F.coalesce("_joyo", F.lit(1)) == 1).drop("_jlpt", "_joyo")


def char_profile(words: DataFrame, char_meta: DataFrame, profile: ScriptProfile) -> DataFrame:
    """word -> its complex characters' lowest level, highest grade (unknown or above 8 counts as 9), whether all are graded, and lists in order.

    A word of simple letters only has level 5; one whose characters have no level at all has level 0."""
    rows = with_chars(words.select("word"), words, char_meta, profile)
    levels = F.coalesce(F.array_join(F.transform("_l", lambda x: x["v"].cast("string")), ","), F.lit(""))
    return rows.select("word", "jlpt", "highest_grade", "joyo", levels.alias("jlpt_values"))


def score_words(words: DataFrame, lexicon: DataFrame, char_meta: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Distinct words (word, base_form) -> reading, meaning, level, score and its parts: looked up by base form, else by surface.

    Each key of the lexicon has its best variant worked out once, without the words: a word asks for its base form and, if that is another,
    for itself, and takes the first answer."""
    words = words.where("word IS NOT NULL")
    asking = words.select("word", F.posexplode(F.array_distinct(F.array("base_form", "word"))).alias("_rank", "_key"))
    best = lookup.best_variant(lookup.lexicon_keys(lexicon), profile).select(F.col("word").alias("_key"), F.struct("pronounced", "priorities", "gloss").alias("_v"))
    answers = asking.join(best.hint("shuffle_hash"), "_key", "left").repartition("word")  # two rows of a word at most: nothing to combine before
    rows = answers.groupBy("word").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_rank"))).alias("_v"))
    rows = with_chars(rows, words, char_meta, profile)
    frequency = S.freq_penalty(F.when(F.col("_v").isNotNull(), F.coalesce("_v.priorities", F.array().cast("array<string>"))), F.col("word"), profile.kana_word.replace("+", "{1,3}"))
    rows = rows.withColumn("freq_penalty", frequency)
    score = S.word_score(F.col("jlpt"), F.coalesce("highest_grade", F.lit(0)), F.col("freq_penalty"))
    return rows.select("word", F.coalesce("_v.pronounced", "word").alias("reading"), F.coalesce("_v.gloss", F.lit("Unknown meaning")).alias("meaning"), "jlpt", "joyo", "highest_grade", "freq_penalty", score.alias("score"))


def surface_counts(tokens: DataFrame) -> DataFrame:
    """Tokens -> content_id, surface, base_form (the last seen), frequency, ord (first position)."""
    return tokens.groupBy("content_id", "surface").agg(F.max_by("base_form", "pos").alias("base_form"), F.count(F.lit(1)).alias("frequency"), F.min("pos").alias("ord"))


def run_surfaces(content: DataFrame, profile: ScriptProfile) -> DataFrame:
    """surface_counts of a text's script runs, counted where the texts are read: their base forms follow from the surfaces."""
    return with_base(run_counts(content, profile), profile)


def with_base(surfaces: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Surfaces of script runs with their base forms."""
    return surfaces.withColumn("base_form", base_form(F.col("surface")) if profile.lower else F.col("surface"))


def counted_words(surfaces: DataFrame, profile: ScriptProfile) -> DataFrame:
    """surface_counts without noise and single letters, surfaces named word."""
    return kept_words(surfaces, profile).select("content_id", F.col("surface").alias("word"), "base_form", "frequency", "ord")


def kept_words(surfaces: DataFrame, profile: ScriptProfile, name: str = "surface") -> DataFrame:
    """Rows whose surface is neither noise nor a single letter."""
    surface = F.col(name)
    return surfaces.where(~T.token_is_noise(surface, profile) & ~surface.rlike(profile.single))


def word_counts(tokens: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Tokens -> content_id, word, base_form (the last seen), frequency, ord (first position); noise and single letters dropped."""
    return counted_words(surface_counts(tokens), profile)


def distinct_words(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.min("base_form").alias("base_form"))


def vocab_extract(tokens: DataFrame, lexicon: DataFrame, char_meta: DataFrame, morphemes: DataFrame, profile: ScriptProfile) -> DataFrame:
    """Tokens of texts -> one row for each (content, word), scored, then the defined single letters with score 0."""
    return vocab_of(surface_counts(tokens), lexicon, char_meta, morphemes, profile)


def vocab_of(surfaces: DataFrame, lexicon: DataFrame, char_meta: DataFrame, morphemes: DataFrame, profile: ScriptProfile) -> DataFrame:
    """vocab_extract from surface_counts, which are read several times and so better written before (sources.staging).

    Words are made distinct before lookups, so those cost by vocabulary and not by text."""
    scored = score_words(distinct_words(counted_words(surfaces, profile)), lexicon, char_meta, profile)
    return vocab_with(surfaces, scored, morphemes, profile)


def single_words(morphemes: DataFrame) -> DataFrame:
    """Defined single letters (morpheme, definition) as rows of scored words: score 0."""
    word = F.col("morpheme").alias("word")
    return morphemes.select(word, F.col("morpheme").alias("reading"), F.col("definition").alias("meaning"), F.lit(0).alias("jlpt"), F.lit(False).alias("joyo"), F.lit(0).alias("score"))


def vocab_with(surfaces: DataFrame, scored: DataFrame, morphemes: DataFrame, profile: ScriptProfile, in_order: bool = False, by_part: bool = False, own: tuple[str, ...] = ()) -> DataFrame:
    """vocab_of from words that are scored already (scored: a row for each distinct word), so surfaces are read for their counts alone."""
    return vocab_from(surfaces, scored, single_words(morphemes), profile, in_order, by_part, own)


def vocab_from(surfaces: DataFrame, scored: DataFrame, singles: DataFrame, profile: ScriptProfile, in_order: bool = False, by_part: bool = False, own: tuple[str, ...] = ()) -> DataFrame:
    """vocab_with from scored words and scored single letters, which may be a part of all and whose other columns come along: what
    depends on the word alone is worked out and chosen before the join, which is the only one on all words of all texts.

    A task of the join holds its share of the distinct words, and the words of the texts stream past it unsorted; in_order sorts both by
    word, so that in a shuffle that follows the equal values of one word lie together and take little room. surfaces may be groups
    (places.run_groups, also without frequencies and ords), which are unfolded after the join; by_part deals these by part before, so that all words of a text lie in
    one task and what is added up or ranked by text shrinks before it is shuffled. own are columns of the groups that come along: with by_part
    and "part", what is gathered by part and text isn't shuffled again."""
    more = [c for c in scored.columns if c in singles.columns and c not in ("word", "reading", "meaning", "jlpt", "joyo", "score")]
    columns = ("content_id", "word", "reading", "meaning", "jlpt", "joyo", "score", "frequency", "ord", "is_morpheme", *more)
    of_word = ("word", "reading", "meaning", "jlpt", "joyo", "score", *more)
    counted = kept_words(scored, profile, "word").select(*of_word, F.lit(False).alias("is_morpheme"))  # words that don't count meet no row, so only these are tested
    letters = singles.where(F.col("word").rlike(profile.single)).select(*of_word, F.lit(True).alias("is_morpheme"))
    values = counted.unionByName(letters).hint("merge" if in_order else "shuffle_hash")
    rows = surfaces.withColumnRenamed("surface", "word").join(values, "word")
    if "content_id" not in rows.columns:
        rows = ungrouped(rows.repartition("part") if by_part else rows, own)
    return rows.select(*[c for c in (*columns, *own) if c in rows.columns])


def vocab_places(surfaces: DataFrame, morphemes: DataFrame, profile: ScriptProfile) -> DataFrame:
    """content_id, word and ord of the vocabulary, for which no word is looked up."""
    letters = surfaces.where(F.col("surface").rlike(profile.single)).select("content_id", F.col("surface").alias("word"), "ord")
    letters = letters.join(F.broadcast(single_words(morphemes).select("word")), "word", "left_semi")
    kept = kept_words(surfaces, profile).select("content_id", F.col("surface").alias("word"), "ord")
    return kept.unionByName(letters.select("content_id", "word", "ord"))


def annotate_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each token with its word's row in the vocabulary of its text, if it has one."""
    info = vocab.select("content_id", F.col("word").alias("surface"), "meaning", "score", "is_morpheme")
    return tokens.join(info, ["content_id", "surface"], "left")


def annotate_by_word(tokens: DataFrame, scored: DataFrame, morphemes: DataFrame) -> DataFrame:
    """annotate_tokens with the vocabulary of all the tokens: what it says of a word is the same in every text, so tokens meet the words."""
    columns = ("word", "meaning", "score", "is_morpheme")
    words = scored.withColumn("is_morpheme", F.lit(False)).select(*columns).unionByName(single_words(morphemes).withColumn("is_morpheme", F.lit(True)).select(*columns))
    return tokens.join(words.hint("shuffle_hash"), F.when(F.col("content_id").isNotNull(), F.col("surface")) == F.col("word"), "left").drop("word")


def srs_stage(words: DataFrame, srs: DataFrame, profile: ScriptProfile) -> DataFrame:
    """word -> the least stage of its started characters, null where none is started."""
    stages = F.broadcast(srs.select("ch", "stage"))  # one row for each character of a script
    least = lookup.word_chars(words, profile).join(stages, "ch").groupBy("word").agg(F.min("stage").alias("stage"))
    return words.select("word").join(least, "word", "left")


def with_srs(vocab: DataFrame, srs: DataFrame, profile: ScriptProfile) -> DataFrame:
    """vocab with stage, base_score and the adjusted score; stages are worked out once for each distinct word."""
    stages = srs_stage(vocab.select("word").distinct(), srs, profile)
    base = F.col("base_score") if "base_score" in vocab.columns else F.col("score")
    rows = vocab.withColumn("base_score", F.coalesce(base, "score")).join(stages, "word", "left")
    return rows.withColumn("score", S.srs_adjust(F.col("score"), F.col("base_score"), F.col("stage")))


def content_status(content: DataFrame, vocab: DataFrame, known: DataFrame) -> DataFrame:
    """Per content: words, unknown words, difficulty, score and comprehension; content without vocabulary has zeros.

    vocab has score and stage; a word is known if it is in known or its stage is high enough, and a known word counts its
    score if it has a stage, else half of it."""
    return status_of(content, marked_known(vocab, known))


def marked_known(words: DataFrame, known: DataFrame) -> DataFrame:
    """words (word, stage, ...) with known: whether a word is in known or its stage is high enough."""
    marked = words.join(known.select(F.col("word").alias("_k")).distinct(), F.col("word") == F.col("_k"), "left")
    is_known = F.col("_k").isNotNull() | F.coalesce(F.col("stage") >= S.KNOWN_STAGE, F.lit(False))
    return marked.withColumn("known", is_known).drop("_k")


def status_of(content: DataFrame, marked: DataFrame) -> DataFrame:
    """content_status from vocabulary whose known words are marked."""
    rows = marked.select("content_id", "score", "stage", "known")
    unknown = ~F.col("known")
    weight = F.when(unknown | F.col("stage").isNotNull(), F.col("score") * F.lit(1.0)).otherwise(F.col("score") * F.lit(0.5))
    per = rows.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count(F.when(unknown, 1)).alias("unknown_count"),
        F.coalesce(F.sum(F.when(unknown, F.col("score"))), F.lit(0)).alias("total_unknown_score"),
        F.sum(weight).alias("status_score"),
    )
    out = content.select("content_id").join(per, "content_id", "left").na.fill(0)
    difficulty = F.coalesce(F.floor(F.try_divide(F.col("total_unknown_score"), F.col("unknown_count")) + 0.5), F.lit(0))
    comprehension = F.coalesce(T.percent(F.col("total_count") - F.col("unknown_count"), F.col("total_count")), F.lit(0))
    return out.withColumn("difficulty", difficulty).withColumn("comprehension", comprehension)


def known_impact(vocab: DataFrame, known: DataFrame) -> DataFrame:
    """Half of the scores of known words, per content; repetition stages don't matter here."""
    return half_scores(known_semi(vocab, known))


def half_scores(known: DataFrame) -> DataFrame:
    """known_impact from vocabulary of known words alone."""
    return known.groupBy("content_id").agg((F.sum("score") * 0.5).alias("impact"))


def unknown_anti(vocab: DataFrame, known: DataFrame) -> DataFrame:
    return vocab.join(known.select("word"), "word", "left_anti")


def known_semi(vocab: DataFrame, known: DataFrame) -> DataFrame:
    return vocab.join(known.select("word"), "word", "left_semi")


def known_word_info(known: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each known word with its first row in any vocabulary, by content and position."""
    first = vocab.groupBy("word").agg(F.min_by(F.struct("content_id", "meaning", "score"), F.struct("content_id", "ord")).alias("_f"))
    return known.select("word").distinct().join(first, "word", "left").select("word", "_f.content_id", "_f.meaning", "_f.score")


def known_words_clean(words: DataFrame) -> DataFrame:
    return words.where(F.col("word").isNotNull() & (F.regexp_replace("word", r"[\s　]", "") != ""))


def score_missing(vocab: DataFrame, scored: DataFrame) -> DataFrame:
    """Absent scores, levels and joyo flags are filled from scored (the least of a word that occurs more than once); present values, 0 included, stay."""
    fill = scored.groupBy("word").agg(*[F.min(c).alias(f"_{c}") for c in ("score", "jlpt", "joyo")])
    rows = vocab.join(fill, "word", "left")
    for c in ("score", "jlpt", "joyo"):
        rows = rows.withColumn(c, F.coalesce(c, f"_{c}"))
    return rows.drop("_score", "_jlpt", "_joyo")


def word_override(vocab: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections (word, score, grade, priorities: strings as typed) replace values: bad numbers become 0, joyo is grade up to 8.

    Of several corrections of a word the last in order of its strings takes effect."""
    corrections = corrections.groupBy("word").agg(F.max(F.struct("score", "grade", "priorities")).alias("_c")).select("word", "_c.*")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS int)"), F.lit(0))
    fixed = corrections.select(F.col("word"), number("score").alias("_score"), (number("grade") <= 8).alias("_joyo"), F.array_join(F.filter(F.transform(F.split("priorities", ","), lambda p: F.trim(p)), lambda p: p != ""), ",").alias("priorities"))
    rows = vocab.join(fixed, "word", "left")
    rows = rows.withColumn("score", F.coalesce("_score", "score")).withColumn("joyo", F.coalesce("_joyo", "joyo"))
    return rows.drop("_score", "_joyo")


def top_unknown(vocab: DataFrame, known: DataFrame, n: int | None = 10) -> DataFrame:
    """Unknown words of each content by frequency, ties in order of the text."""
    return first_frequent(unknown_anti(vocab, known), n)


def first_frequent(unknown: DataFrame, n: int | None = 10) -> DataFrame:
    order = W.partitionBy("content_id").orderBy(F.col("frequency").desc_nulls_last(), "ord", "word")
    rows = unknown.withColumn("n", F.row_number().over(order))
    return rows if n is None else rows.where(F.col("n") <= n)


def unknown_preview(vocab: DataFrame, known: DataFrame, status: DataFrame, n: int = 6) -> DataFrame:
    """The first n unknown words, and how many more there are, of content that is almost understood."""
    return preview_of(unknown_anti(vocab, known), status, n)


def preview_of(unknown: DataFrame, status: DataFrame, n: int = 6) -> DataFrame:
    """unknown_preview from the unknown words alone."""
    almost = status.where("comprehension BETWEEN 90 AND 99").select("content_id")
    order = W.partitionBy("content_id").orderBy("ord", "word")
    rows = unknown.join(almost, "content_id", "left_semi").withColumn("n", F.row_number().over(order))
    per = rows.groupBy("content_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= n, F.struct("n", "word")))).alias("_p"), F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("n_more"))
    return per.select("content_id", F.array_join(F.transform("_p", lambda p: p["word"]), ",").alias("preview"), "n_more")


def lesson_queue(vocab: DataFrame, known: DataFrame, n: int = 50) -> DataFrame:
    return first_seen(unknown_anti(vocab, known), n)


def first_seen(unknown: DataFrame, n: int = 50) -> DataFrame:
    order = W.partitionBy("content_id").orderBy("ord", "word")
    return unknown.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def next_words(vocab: DataFrame, known: DataFrame, n: int = 100) -> DataFrame:
    """Distinct unknown words over all content, first seen first."""
    first = vocab.groupBy("word").agg(F.min(F.struct("content_id", "ord")).alias("_f"))
    return unknown_anti(first, known).orderBy("_f.content_id", "_f.ord", "word").limit(n).select("word")


def unknown_meanings(vocab: DataFrame) -> DataFrame:
    """First row of each word without a meaning."""
    rows = vocab.where("meaning = 'Unknown meaning'")
    return rows.groupBy("word").agg(F.min_by(F.struct("content_id", "score"), F.struct("content_id", "ord")).alias("_f")).select("word", "_f.*")


def rank_content(content: DataFrame, status: DataFrame, query: str = "", types: tuple[str, ...] = (), comprehension: str = "all", offset: int = 0, page: int = 12) -> DataFrame:
    """Filtered content, loaded before unloaded, easiest first, ties in order: one page. Spark plans it as a top-k."""
    rows = content.join(status, "content_id").where(T.title_matches(F.col("title"), query))
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if comprehension == "almost":
        rows = rows.where("total_count > 0 AND comprehension BETWEEN 90 AND 99")
    elif comprehension == "ready":
        rows = rows.where("total_count > 0 AND comprehension = 100")
    return rows.orderBy(F.col("total_count") == 0, "status_score", "content_id").offset(offset).limit(page)
