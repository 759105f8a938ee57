"""Queries on dictionaries, content tables, sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import scoring as S
from lexispark.functions import stems
from lexispark.functions import text as T
from lexispark.functions.profiles import LATIN
from lexispark.operators import base_forms as B
from lexispark.operators import content as C
from lexispark.operators import lookup as L
from lexispark.operators import reports as R
from lexispark.plans import inputs as I
from lexispark.plans.inputs import sql
from lexispark.plans.vocabulary import STEM_SQL
from lexispark.sources import backup, files, sinks, stored
from lexispark.sources.char_index import CharIndex
from lexispark.sources.staging import new_path
from lexispark.streaming import incremental

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = I.fresh(f)
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


def plain(spark, d):
    """Words to look up: accent-free forms of the vocabulary."""
    return I.words(spark, d).select(F.col("base_form").alias("word")).distinct()


MATCH = "(SELECT w.word, l.* FROM (SELECT DISTINCT base_form AS word FROM words) w JOIN lexicon l ON l.written = w.word UNION ALL SELECT w.word, l.* FROM (SELECT DISTINCT base_form AS word FROM words) w JOIN lexicon l ON l.pronounced = w.word AND l.written <> l.pronounced)"


@query("dict_lookup_exact", sql(f"SELECT word, written, pronounced, entry_pos FROM {MATCH}", "words", "lexicon"))
def dict_lookup_exact(spark, d):
    return L.dict_lookup_exact(plain(spark, d), I.lexicon(spark, d)).select("word", "written", "pronounced", "entry_pos")


STEM = STEM_SQL.replace("word", "{c}")
CAND = f"(CASE WHEN length(base_form) > 2 THEN {STEM.format(c='base_form')} ELSE [base_form] END) || (CASE WHEN length(word) > 2 THEN {STEM_SQL} ELSE [word] END)"


@query("dict_lookup_fallback", sql(f"SELECT word, arg_min(key, r) AS key FROM (SELECT word, unnest(cs) AS key, generate_subscripts(cs, 1) r FROM (SELECT word, {CAND} AS cs FROM words)) JOIN keys USING (key) GROUP BY word", "words", "keys"))
def dict_lookup_fallback(spark, d):
    return L.dict_lookup_fallback(I.words(spark, d), I.lexicon(spark, d), stems.LATIN_RULES).select("word", "key")


@query("stem_lookup", sql(f"SELECT w.word, coalesce(f.key, w.word) AS found FROM words w LEFT JOIN (SELECT word, arg_min(key, r) AS key FROM (SELECT word, unnest(cs) AS key, generate_subscripts(cs, 1) r FROM (SELECT word, CASE WHEN length(word) > 2 THEN {STEM_SQL} ELSE [word] END AS cs FROM words)) JOIN keys USING (key) GROUP BY word) f USING (word)", "words", "keys"))
def stem_lookup(spark, d):
    return L.stem_lookup(I.words(spark, d).select("word"), I.lexicon(spark, d), stems.LATIN_RULES)


@query("entry_order_kana", sql(f"SELECT word, entry_id, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN regexp_matches(word, '^[a-z]+$') AND (regexp_matches(written, '^[a-z]+$') OR pronounced = word) THEN 0 ELSE 1 END, entry_pos, entry_id) - 1 AS entry_rank FROM {MATCH}", "words", "lexicon"))
def entry_order_kana(spark, d):
    return L.entry_order(L.dict_lookup_exact(plain(spark, d), I.lexicon(spark, d)), LATIN)


@query("best_variant", sql("SELECT k AS word, written, pronounced, vs AS variant_score FROM best_base", "best_base"))
def best_variant(spark, d):
    return L.best_variant(L.dict_lookup_exact(plain(spark, d), I.lexicon(spark, d)), LATIN).select("word", "written", "pronounced", "variant_score")


@query("reading_then_kanji_lookup", sql("SELECT word, tier, entry_id, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY entry_pos, entry_id) n FROM (SELECT *, min(tier) OVER (PARTITION BY word) b FROM (SELECT word, 1 AS tier, entry_id, entry_pos FROM words JOIN lexicon ON pronounced = word UNION ALL SELECT word, 2, entry_id, entry_pos FROM words JOIN lexicon ON written = word)) WHERE tier = b) WHERE n <= 10", "words", "lexicon"))
def reading_then_kanji_lookup(spark, d):
    return L.reading_then_kanji_lookup(I.words(spark, d).select("word"), I.lexicon(spark, d))


COMMON = "(CASE WHEN nk > 0 THEN 10 ELSE 0 END + CASE WHEN nk > 1 THEN 5 ELSE 0 END + CASE WHEN ns > 1 THEN 3 ELSE 0 END)"
ENTRY = "(SELECT *, length(regexp_replace(written, '[^à-öø-ÿß]', '', 'g')) AS nk, n % 3 AS ns FROM lexicon)"


def entries(spark, d):
    """Dictionary entries with counts of writings (complex characters here) and senses."""
    return I.lexicon(spark, d).withColumn("n_kanji", F.length(F.regexp_replace("written", "[^à-öø-ÿß]", ""))).withColumn("n_senses", (F.col("n") % 3).cast("int"))


@query("entry_commonness", sql(f"SELECT entry_id, {COMMON} AS commonness FROM {ENTRY}", "lexicon"))
def entry_commonness(spark, d):
    return entries(spark, d).select("entry_id", S.entry_commonness(F.col("n_kanji"), F.col("n_senses")).alias("commonness"))


@query("dict_best_entry", sql(f"SELECT word, arg_max(entry_id, (ex, CASE WHEN ex = 1 THEN 0 ELSE {COMMON} END, -entry_pos)) AS entry_id FROM (SELECT pronounced AS word, *, CASE WHEN written = pronounced THEN 1 ELSE 0 END ex FROM {ENTRY}) GROUP BY word", "lexicon"))
def dict_best_entry(spark, d):
    e = entries(spark, d)
    return L.dict_best_entry(e.select(F.col("pronounced").alias("word"), "entry_id", F.col("entry_pos").alias("pos"), (F.col("written") == F.col("pronounced")).alias("exact"), "n_kanji", "n_senses"))


def one_gloss():
    """A sense of one gloss: rare, auxiliary or plain by the word's count."""
    return F.array(F.concat(F.when(F.col("n") % 4 == 0, "rare ").when(F.col("n") % 4 == 1, "auxiliary ").otherwise(""), F.col("written")))


@query("sense_commonness", sql("SELECT entry_id, CASE WHEN n % 5 = 0 THEN 5 ELSE 0 END - CASE WHEN len(list_filter(['esp.', 'rare', 'archaic', 'obsolete', 'old', 'dated', 'specialized'], lambda t: contains(g, t))) > 0 THEN 10 ELSE 0 END + CASE WHEN contains(g, 'copula') OR contains(g, 'auxiliary') THEN 3 ELSE 0 END AS commonness FROM (SELECT *, CASE n % 4 WHEN 0 THEN 'rare ' WHEN 1 THEN 'auxiliary ' ELSE '' END || written AS g FROM lexicon)", "lexicon"))
def sense_commonness(spark, d):
    glosses = F.when(F.col("n") % 5 == 0, F.concat(one_gloss(), F.array(F.lit("more")))).otherwise(one_gloss())
    return I.lexicon(spark, d).select("entry_id", S.sense_commonness(glosses).alias("commonness"))


GLOSS = "CASE n % 4 WHEN 0 THEN 'rare ' WHEN 1 THEN 'auxiliary ' ELSE '' END || written"
#: What the terms in a gloss add to the rank of its sense, as in sense_commonness.
TERMS = "(CASE WHEN len(list_filter(['esp.', 'rare', 'archaic', 'obsolete', 'old', 'dated', 'specialized'], lambda t: contains({g}, t))) > 0 THEN -10 ELSE 0 END + CASE WHEN contains({g}, 'copula') OR contains({g}, 'auxiliary') THEN 3 ELSE 0 END)"


@query("dict_meanings", sql(f"SELECT entry_id, CASE WHEN {TERMS.format(g='first')} >= {TERMS.format(g='plain')} THEN first || '; ' || plain ELSE plain || '; ' || first END AS meanings FROM (SELECT entry_id, {GLOSS} AS first, 'plain ' || written AS plain FROM lexicon)", "lexicon"))
def dict_meanings(spark, d):
    return I.lexicon(spark, d).select("entry_id", F.array_join(S.dict_meanings(F.array(one_gloss(), F.array(F.concat(F.lit("plain "), "written")))), "; ").alias("meanings"))


@query("first_entry_meaning", sql(f"SELECT word, gloss AS meaning FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN regexp_matches(word, '^[a-z]+$') AND (regexp_matches(written, '^[a-z]+$') OR pronounced = word) THEN 0 ELSE 1 END, entry_pos, entry_id) rn FROM {MATCH}) WHERE rn = 1", "words", "lexicon"))
def first_entry_meaning(spark, d):
    return L.first_entry_meaning(L.dict_lookup_exact(plain(spark, d), I.lexicon(spark, d)), LATIN)


NAMES = "(SELECT pronounced AS key, n AS p, written AS w, 0 AS o, 'name ' || written AS meaning, pronounced AS reading FROM lexicon WHERE n % 2 = 0 UNION ALL SELECT written, n, written, 1, 'name ' || written, pronounced FROM lexicon WHERE n % 2 = 0 AND written <> pronounced)"


def names(spark, d):
    rows = I.lexicon(spark, d).where("n % 2 = 0")
    pos = F.struct(F.col("n").alias("p"), F.col("written").alias("w"))
    return rows.select(pos.alias("entry_pos"), F.col("pronounced").alias("kana"), F.col("written").alias("kanji"), F.array(F.concat(F.lit("name "), "written")).alias("meanings"))


@query("names_index", sql(f"SELECT key, meaning, reading FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, w, o) rn FROM {NAMES}) WHERE rn = 1", "lexicon"))
def names_index(spark, d):
    return L.names_index(names(spark, d))


TIERS = f"(SELECT key, meaning, 0 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, w, o) rn FROM {NAMES}) WHERE rn = 1 UNION ALL SELECT written, 'a ' || written, 1 FROM lexicon WHERE n % 3 = 0 UNION ALL SELECT written, 'b ' || written, 2 FROM lexicon WHERE n % 5 < 2 UNION ALL SELECT written, gloss, 3 FROM lexicon)"
CHAIN = f"SELECT word, arg_min(meaning, (tier, meaning)) AS meaning, min(tier) AS tier FROM words JOIN {TIERS} t ON t.key = word WHERE tier > 0 OR regexp_matches(word, '^[a-z]+$') GROUP BY word"


def tiers(spark, d):
    lex = I.lexicon(spark, d)
    one = lambda rows, meaning: rows.select(F.col("written").alias("key"), meaning.alias("meaning"))
    return [L.names_index(names(spark, d)), one(lex.where("n % 3 = 0"), F.concat(F.lit("a "), "written")), one(lex.where("n % 5 < 2"), F.concat(F.lit("b "), "written")), one(lex, F.col("gloss"))]


@query("dict_chain", sql(CHAIN, "words", "lexicon"))
def dict_chain(spark, d):
    return L.dict_chain(I.words(spark, d), tiers(spark, d), LATIN)


OVERRIDE = "SELECT word, coalesce(CASE WHEN regexp_matches(word, '^[a-z]+$') OR regexp_matches(word, '^[A-Z]+$') THEN coalesce(c.meaning, s.meaning) ELSE s.meaning END, CASE WHEN regexp_matches(word, '^[a-z]+$') THEN 'Kana particle / expression' END, 'Unknown meaning') AS meaning FROM (SELECT word, CASE WHEN length(word) % 2 = 0 THEN meaning END AS meaning FROM scored WHERE meaning <> 'Unknown meaning' UNION ALL SELECT word, NULL FROM scored WHERE meaning = 'Unknown meaning') s LEFT JOIN (" + CHAIN + ") c USING (word)"


@query("kana_override", sql(OVERRIDE, "words", "lexicon", "scored"))
def kana_override(spark, d):
    scored = I.scored(spark, d)
    rows = scored.select("word", F.when((F.col("meaning") != "Unknown meaning") & (F.length("word") % 2 == 0), F.col("meaning")).alias("meaning"))
    return L.kana_override(rows, dict_chain(spark, d), LATIN)


@query("kana_default", sql("SELECT word, CASE WHEN meaning = 'Unknown meaning' AND regexp_matches(word, '^[a-z]+$') THEN 'Kana particle / expression' ELSE meaning END AS meaning FROM scored", "scored"))
def kana_default(spark, d):
    scored = I.scored(spark, d)
    nothing = F.nullif("meaning", F.lit("Unknown meaning"))
    rows = scored.select("word", nothing.alias("meaning"))
    return L.kana_override(rows, rows.where("false"), LATIN)


@query("morpheme_join", sql("SELECT content_id, word, meaning, score, jlpt, joyo FROM vocab WHERE is_morpheme", "vocab"))
def morpheme_join(spark, d):
    return I.vocab(spark, d).where("is_morpheme").select("content_id", "word", "meaning", "score", "jlpt", "joyo")


@query("char_entries", sql("SELECT c.word, c.ch, e.entry_id FROM (SELECT DISTINCT word, ch FROM chars JOIN known USING (word)) c JOIN (SELECT DISTINCT entry_id, unnest(regexp_extract_all(written, '[à-öø-ÿß]')) AS ch FROM lexicon) e ON e.ch = c.ch", "chars", "known", "lexicon"))
def char_entries(spark, d):
    """The learner's words: all entries that share a complex character with them."""
    index = CharIndex.write(L.char_postings(I.lexicon(spark, d), LATIN), new_path(spark, "characters"))
    known = I.words(spark, d).select("word").join(I.known_words(spark, d), "word", "left_semi")
    return L.char_entries(known, index, LATIN)


@query("word_detail", sql("SELECT b.k AS word, b.written, b.vs AS variant_score, g.glosses, g.n_glosses FROM best_base b JOIN (SELECT word, string_agg(gloss, '; ' ORDER BY entry_pos, entry_id) AS glosses, count(*)::INT AS n_glosses FROM " + MATCH + " GROUP BY word) g ON g.word = b.k", "best_base"))
def word_detail(spark, d):
    return L.word_detail(plain(spark, d), I.lexicon(spark, d), LATIN).select("word", "written", "variant_score", "glosses", "n_glosses")


@query("related_words", sql("SELECT word, n, related FROM (SELECT a.word, b.word AS related, row_number() OVER (PARTITION BY a.word ORDER BY b.o, b.word) AS n FROM (SELECT a.word, b.word AS related FROM (SELECT DISTINCT word, ch FROM chars) a JOIN (SELECT DISTINCT word, ch FROM chars) b ON a.ch = b.ch AND a.word <> b.word GROUP BY 1, 2) a JOIN (SELECT word, min((content_id, ord)) AS o FROM counts GROUP BY word) b ON b.word = a.related) WHERE n <= 10", "chars", "counts"))
def related_words(spark, d):
    first = I.counts(spark, d).groupBy("word").agg(F.min(F.struct("content_id", "ord")).alias("ord"))
    return L.related_words(first, LATIN)


@query("dict_compare", sql("SELECT word, CASE WHEN n % 3 = 0 THEN 'a ' || written END AS a, CASE WHEN n % 5 < 2 THEN 'b ' || written END AS b, gloss AS c, (coalesce(n % 3 = 0, false)::INT + coalesce(n % 5 < 2, false)::INT + (gloss IS NOT NULL)::INT)::INT AS n_found FROM words LEFT JOIN lexicon ON written = word", "words", "lexicon"))
def dict_compare(spark, d):
    return L.dict_compare(I.words(spark, d), dict(zip("abc", tiers(spark, d)[1:], strict=True)))


@query("dict_accuracy", sql("SELECT e.word, e.expected, s.meaning, coalesce(contains(lower(s.meaning), x) OR contains(x, lower(s.meaning)), false) AS correct FROM (SELECT word, base_form || ' (note)/x' AS expected, base_form AS x FROM words) e LEFT JOIN scored s USING (word)", "scored"))
def dict_accuracy(spark, d):
    scored = I.scored(spark, d).select("word", "meaning")
    return L.dict_accuracy(scored, I.words(spark, d).select("word", F.concat("base_form", F.lit(" (note)/x")).alias("expected")))


@query("lookup_snapshot", sql("SELECT word, gloss AS meaning, gloss IS NOT NULL AS found FROM words LEFT JOIN best_surface ON k = word", "words", "best_surface"))
def lookup_snapshot(spark, d):
    """Half of the words are looked up first; then all, of which only the other half is looked up. Answers of an older dictionary don't count."""
    lexicon, words = I.lexicon(spark, d), I.words(spark, d).select("word")
    path = new_path(spark, "lookups")
    look = lambda absent: L.best_variant(L.dict_lookup_exact(absent, lexicon), LATIN).select("word", F.col("gloss").alias("meaning"))
    stored.LookupCache(spark, path, "older").resolve(words.where("length(word) < 4"), lambda absent: absent.withColumn("meaning", F.lit("old")))
    cache = stored.LookupCache(spark, path, stored.table_version(lexicon))
    cache.resolve(words.where("length(word) % 2 = 0"), look)
    return cache.resolve(words, look)


@query("word_dict_ingest", sql("SELECT written AS entry_id, pronounced, 1 AS n_kanji, 2 AS n_senses, 'rare x; plain ' || written AS meanings FROM lexicon", "lexicon"))
def word_dict_ingest(spark, d):
    """Entries written as JSON lines and read back."""
    gloss = lambda lang, text: F.struct(F.lit(lang).alias("lang"), text.alias("text"))
    senses = F.array(F.struct(F.array(gloss("en", F.lit("rare x"))).alias("gloss")), F.struct(F.array(gloss("fr", F.concat(F.lit("plain "), "written"))).alias("gloss")))
    one = lambda c: F.array(F.struct(F.col(c).alias("text")))
    lines = I.lexicon(spark, d).select(F.to_json(F.struct(F.col("written").alias("id"), one("written").alias("kanji"), one("pronounced").alias("kana"), senses.alias("sense"))).alias("value"))
    path = new_path(spark, "entries")
    lines.write.text(path)
    return files.word_dict_ingest(spark, path).select("entry_id", "pronounced", "n_kanji", "n_senses", F.array_join(F.flatten("senses"), "; ").alias("meanings"))


def through_file(lines, name):
    """lines (value) written as text and read back."""
    path = new_path(lines.sparkSession, name)
    lines.select("value").write.option("compression", "gzip").text(path)
    return lines.sparkSession.read.text(path)


@query("backup_read", sql("SELECT content_id::VARCHAR AS content_id, word, reading, meaning, score FROM vocab", "vocab"))
def backup_read(spark, d):
    """Vocabulary written as JSON lines and read back."""
    vocab = I.vocab(spark, d, by_part=True, asked=("ords",), own=("part",))
    return files.backup_read(through_file(sinks.backup_lines(vocab), "backup"))[1]


@query("backup_document", sql("SELECT content_id::VARCHAR AS content_id, word, reading, meaning, score FROM vocab", "vocab"))
def backup_document(spark, d):
    """Vocabulary written as 16 documents of all their contents in packed parts, each read back in parallel.

    Contents are gathered where their words are and written from there; a line lacks the brace that ends it, which the writer adds, so
    that every part ends behind one. What opens and closes a document are parts of their own."""
    per = I.vocab(spark, d, by_part=True, asked=(), own=("part",)).groupBy("part", "content_id").agg(F.sort_array(F.collect_list(F.struct("word", "reading", "meaning", "score"))).alias("_w"))
    words = F.to_json("_w")
    line = F.concat(F.lit('],"'), F.col("content_id").cast("string"), F.lit('":'), F.substring(words, F.lit(1), F.length(words) - 2))
    rows = per.select(F.pmod(F.xxhash64("content_id"), F.lit(16)).alias("doc"), F.lit(1).alias("ord"), line.alias("value"))
    ends = spark.range(16).select(F.col("id").alias("doc"), F.explode(F.expr("map(0, '{\"contentVocab\":{\"first\":[{', 2, '],\"last\":[]}')")).alias("ord", "value"))
    path = new_path(spark, "documents")
    rows.unionByName(ends).write.partitionBy("doc", "ord").option("lineSep", "}").option("compression", "gzip").text(path)
    return backup.backup_document(spark, path, r"^(.*/doc=[^/]+)/")[1]


@query("backup_write", sql("SELECT word FROM known", "known"))
def backup_write(spark, d):
    """Known words written as JSON lines, read back."""
    return files.backup_read(through_file(sinks.known_lines(I.known_words(spark, d)), "known"))[0]


@query("deck_export", sql("SELECT 0 AS n, '#separator:tab' AS line UNION ALL SELECT row_number() OVER (ORDER BY content_id, ord, word), word || chr(9) || reading || '<br>' || meaning || chr(9) || CASE WHEN jlpt > 0 THEN 'JLPT_N' || jlpt ELSE 'JLPT_native' END FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY content_id, ord) rn FROM vocab WHERE jlpt IN (0, 1, 2) AND word NOT IN (SELECT word FROM known)) WHERE rn = 1", "vocab", "known"))
def deck_export(spark, d):
    """The deck as a file, read back with the numbers of its lines."""
    path = new_path(spark, "deck")
    sinks.deck_export(I.vocab(spark, d).withColumn("priorities", F.lit(None).cast("array<string>")), I.known_words(spark, d), path, (0, 1, 2))
    return sinks.read_export(spark, path).select("n", F.col("value").alias("line"))


@query("story_export", sql("SELECT row_number() OVER (ORDER BY content_id) - 1 AS n, '{\"title\":\"' || title || '\",\"vocab\":[' || coalesce(ws, '') || ']}' AS value FROM content LEFT JOIN (SELECT content_id, string_agg('\"' || word || '\"', ',' ORDER BY word IN (SELECT word FROM known), ord, word) ws FROM vocab GROUP BY content_id) USING (content_id)", "content", "vocab", "known"))
def story_export(spark, d):
    """All contents with their words in one ordered file, read back with the numbers of its lines."""
    path = new_path(spark, "exported")
    known = I.known_words(spark, d).select(F.col("word").alias("_k"))
    marked = I.vocab_where(spark, d, lambda words: words.join(known, F.col("word") == F.col("_k"), "left").withColumn("known", F.col("_k").isNotNull()).drop("_k"))
    sinks.write_lines(sinks.marked_lines(I.content(spark, d), marked), path)
    return sinks.read_export(spark, path)


@query("report_write", sql("SELECT '{\"content_id\":' || content_id || ',\"total\":' || count(*) || ',\"with_definition\":' || count(*) FILTER (WHERE found) || ',\"accuracy\":' || floor(count(*) FILTER (WHERE found) * 100.0::DOUBLE / count(*) + 0.5)::BIGINT || '}' AS value FROM looked GROUP BY content_id", "looked"))
def report_write(spark, d):
    return through_file(sinks.report_lines(R.coverage_unique(I.counts(spark, d), I.lexicon(spark, d))), "report")


@query("vocab_cache_valid", sql("SELECT lang AS snapshot_id, bool_and(content_id % 97 <> 5) AS valid FROM content GROUP BY lang", "content"))
def vocab_cache_valid(spark, d):
    """Snapshots by language; the first word of every 97th content lacks a key, later words may lack any."""
    c = I.content(spark, d)
    first = F.when(F.col("content_id") % 97 == 5, '{"jlptScore": 3}').otherwise('{"jlptScore": null, "highestGrade": null}')
    rows = c.select(F.col("lang").alias("snapshot_id"), "content_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), first.alias("b")), F.struct(F.lit(1).alias("pos"), F.lit("{}").alias("b")))).alias("w"))
    return files.vocab_cache_valid(rows.select("snapshot_id", "content_id", "w.pos", F.col("w.b").alias("breakdown")))


@query("srs_ingest", sql("SELECT ch, arg_max(stage, seq) AS stage FROM (SELECT event_id AS seq, chr((97 + user_id % 26)::INT) AS ch, 1 + event_id % 9 AS stage FROM events WHERE user_id % 26 <> 3) GROUP BY ch"))
def srs_ingest(spark, d):
    e = I.table(spark, d, "events")
    subjects = e.select((F.col("user_id") % 26).alias("id")).distinct().select("id", F.when(F.col("id") != 3, F.char(F.col("id") + 97)).alias("characters"))
    return files.srs_ingest(e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 26).alias("subject_id"), (1 + F.col("event_id") % 9).alias("stage")), subjects)


@query("is_stale", sql("SELECT event_id, epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT > 86400 AS stale FROM events"))
def is_stale(spark, d):
    return I.table(spark, d, "events").select("event_id", T.is_stale(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("stale"))


@query("content_all", sql("SELECT content_id, type, title FROM content", "content"))
def content_all(spark, d):
    return I.all_types(spark, d).select("content_id", "type", "title")


@query("content_by_type", sql("SELECT content_id, title FROM content WHERE type = 'music'", "content"))
def content_by_type(spark, d):
    return I.by_type(spark, d, "music").select("content_id", "title")


@query("type_filter", sql("SELECT content_id, type FROM content WHERE type IN ('story', 'video')", "content"))
def type_filter(spark, d):
    return I.content(spark, d).where(F.col("type").isin("story", "video")).select("content_id", "type")


@query("title_search", sql("SELECT content_id, title FROM content WHERE contains(lower(title), 'src1')", "content"))
def title_search(spark, d):
    return I.content(spark, d).where(T.title_matches(F.col("title"), " SRC1 ")).select("content_id", "title")


@query("slugify", sql("SELECT content_id, regexp_replace(regexp_replace(lower(title || '! ' || text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM content", "content"))
def slugify(spark, d):
    return I.content(spark, d).select("content_id", T.slugify(F.concat("title", F.lit("! "), "text")).alias("slug"))


@query("type_counts", sql("SELECT type, count(*) AS n, count(*) FILTER (WHERE length(text) = 0) AS n_empty FROM content GROUP BY type", "content"))
def type_counts(spark, d):
    return C.type_counts(I.content(spark, d))


@query("content_override", sql("SELECT content_id, content_id AS ord, CASE WHEN content_id % 4 = 0 THEN 'custom ' || title ELSE title END AS title FROM content", "content"))
def content_override(spark, d):
    c = I.content(spark, d).select("content_id", F.col("content_id").alias("ord"), "title")
    return C.content_override(c, c.where("content_id % 4 = 0").select("content_id", (F.col("ord") + 1000).alias("ord"), F.concat(F.lit("custom "), "title").alias("title")))


@query("import_content", sql("SELECT 'custom-' || content_id AS content_id, title, trim(text, ' ' || chr(10) || chr(9)) AS text, CASE WHEN content_id % 2 = 0 THEN 'u' || content_id END AS media_url, 'Custom content' AS description FROM content", "content"))
def import_content(spark, d):
    c = I.content(spark, d)
    url = F.when(F.col("content_id") % 2 == 0, F.concat(F.lit(" u"), F.col("content_id").cast("string"))).otherwise("  ")
    return C.import_content(c.select(F.col("content_id").alias("seq"), F.concat(F.lit("  "), "title", F.lit("\n")).alias("title"), "text", url.alias("url")))


@query("content_sink_new_only", sql("SELECT content_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM content WHERE type = 'story'", "content"))
def content_sink_new_only(spark, d):
    """Half of the stories are there when all are appended, twice."""
    c, path = I.content(spark, d), new_path(spark, "stories")
    for some in (c.where("content_id % 2 = 0"), c, c):
        table = sinks.content_sink_new_only(some, path)
    return table.select("content_id", "slug")


@query("duplicate_groups", sql("SELECT md5(text) AS hash, count(*) AS copies, min(content_id) AS first_id, max(strlen(text))::INT AS bytes FROM content WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1", "content"))
def duplicate_groups(spark, d):
    return C.duplicate_groups(I.content(spark, d))


PLAN = "(SELECT *, count(*) OVER (PARTITION BY md5(text)) AS copies, first_value(content_id) OVER (PARTITION BY md5(text) ORDER BY CASE type WHEN 'story' THEN 1 WHEN 'music' THEN 2 ELSE 3 END, content_id) AS kept_id, first_value(type) OVER (PARTITION BY md5(text) ORDER BY CASE type WHEN 'story' THEN 1 WHEN 'music' THEN 2 ELSE 3 END, content_id) AS kept_type FROM content)"


@query("duplicate_plan", sql(f"SELECT content_id, copies, CASE WHEN content_id = kept_id THEN 'keep' ELSE 'remove' END AS action, kept_id, CASE WHEN content_id = kept_id THEN 'first of ' || copies || ' copies' ELSE 'same text as ' || kept_type || '/' || kept_id END AS reason FROM {PLAN} WHERE copies > 1", "content"))
def duplicate_plan(spark, d):
    return C.duplicate_plan(I.content(spark, d)).select("content_id", "copies", "action", "kept_id", "reason")


@query("deduplicate", sql(f"SELECT content_id, type FROM {PLAN} WHERE content_id = kept_id", "content"))
def deduplicate(spark, d):
    return C.deduplicate(I.content(spark, d)).select("content_id", "type")


@query("deduplicate_report", sql(f"SELECT type, grouping(type)::INT AS is_total, count(*) FILTER (WHERE content_id = kept_id) AS kept, count(*) FILTER (WHERE content_id <> kept_id) AS removed, coalesce(sum(strlen(text)) FILTER (WHERE content_id <> kept_id), 0)::BIGINT AS freed_bytes FROM {PLAN} GROUP BY ROLLUP (type)", "content"))
def deduplicate_report(spark, d):
    return C.deduplicate_report(I.content(spark, d)).withColumn("is_total", F.col("is_total").cast("int"))


@query("vocab_merge", sql("""SELECT content_id, word, CASE WHEN ord % 8 = 2 THEN 'r' ELSE reading END AS reading, CASE WHEN ord % 2 = 0 THEN 'imported ' || word ELSE meaning END AS meaning, score + (ord % 2 = 0)::INT AS score FROM vocab WHERE ord % 2 = 1 OR ord % 3 > 0
    UNION ALL SELECT content_id, word, reading, meaning, score FROM vocab WHERE ord % 6 = 0
    UNION ALL SELECT content_id, 'new ' || word, CASE WHEN ord % 8 = 2 THEN 'r' END, 'imported ' || word, score + 1 FROM vocab WHERE ord % 6 = 0""", "vocab"))
def vocab_merge(spark, d):
    """Half of the words are imported, a third of these under a name that the existing table doesn't have; some come twice, of which the
    later row has no reading."""
    v = I.vocab(spark, d, in_order=True)
    name = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("new "), "word")).otherwise(F.col("word"))
    row = lambda seq, reading, meaning, score: F.struct(F.lit(seq).alias("seq"), reading.cast("string").alias("reading"), meaning.alias("meaning"), score.cast("int").alias("score"))
    last = row(1, F.lit(None), F.concat(F.lit("imported "), "word"), F.col("score") + 1)
    rows = F.when(F.col("ord") % 8 == 2, F.array(row(0, F.lit("r"), F.lit("older"), F.lit(0)), last)).otherwise(F.array(last))
    imported = v.where("ord % 2 = 0").select("content_id", name.alias("word"), F.explode(rows).alias("_r")).select("content_id", "word", "_r.*")
    return C.vocab_merge(v, imported, order="seq")


@query("vocab_update_word", sql("SELECT content_id, word, CASE WHEN word LIKE 'th%' THEN 'new ' || word ELSE meaning END AS meaning, score FROM vocab", "vocab"))
def vocab_update_word(spark, d):
    v = I.vocab(spark, d)
    changes = v.where("word LIKE 'th%'").select("word", F.concat(F.lit("new "), "word").alias("meaning"), F.lit(None).cast("int").alias("score")).distinct()
    return C.vocab_update_word(v, changes).select("content_id", "word", "meaning", "score")


@query("vocab_add_word", sql("SELECT content_id, word, meaning, score, ord FROM vocab UNION ALL SELECT content_id, 'custom', 'Custom Word', 0, coalesce(m, 0) - 1 FROM content LEFT JOIN (SELECT content_id, min(ord) m FROM vocab GROUP BY 1) USING (content_id) WHERE content_id % 3 = 0", "content", "vocab"))
def vocab_add_word(spark, d):
    custom = I.content(spark, d).where("content_id % 3 = 0").select("content_id", F.lit("custom").alias("word"))
    return C.vocab_add_word(I.vocab(spark, d), custom)


@query("related_stories", sql("SELECT parent_id AS content_id, content_id AS other_id, CASE WHEN variant_type IS NOT NULL THEN 'variant' ELSE 'episode' END AS relation, CASE WHEN variant_type IS NULL THEN episode END::INT AS episode FROM relations WHERE parent_id <> content_id UNION ALL SELECT r.content_id, r.related, CASE WHEN o.variant_type IS NOT NULL THEN 'variant' ELSE 'series' END, NULL FROM relations r JOIN relations o ON o.content_id = r.related", "relations"))
def related_stories(spark, d):
    return C.related_stories(I.relations(spark, d))


@query("parent_story", sql("SELECT r.content_id, r.parent_id, p.title AS parent_title FROM relations r LEFT JOIN relations p ON p.content_id = r.parent_id", "relations"))
def parent_story(spark, d):
    return C.parent_story(I.relations(spark, d))


@query("children", sql("SELECT parent_id, content_id, row_number() OVER (PARTITION BY parent_id ORDER BY variant_type IS NOT NULL, CASE WHEN variant_type IS NULL THEN coalesce(episode, 0) ELSE 0 END, title, content_id) AS n FROM relations WHERE parent_id <> content_id", "relations"))
def children(spark, d):
    return C.children(I.relations(spark, d))


@query("series_stories", sql("SELECT series_id, content_id, title FROM relations WHERE series_id IN (SELECT source FROM documents WHERE doc_id < 7)", "relations"))
def series_stories(spark, d):
    wanted = I.content(spark, d).where("content_id < 7").select("series_id").distinct()
    return C.series_stories(I.relations(spark, d), wanted)


def as_files(rows, file, value):
    return rows.select(F.col("folder"), F.lit(file).alias("file"), value.alias("value"))


@query("content_scan", sql("SELECT content_id::VARCHAR AS id, title, type, content_id % 2 = 0 AS dated, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM content WHERE content_id % 7 <> 3 AND content_id % 11 <> 4", "content"))
def content_scan(spark, d):
    """Documents as folders of two files: some lack the body, the metadata of some don't parse."""
    c = I.content(spark, d).withColumn("folder", F.col("content_id").cast("string"))
    meta = F.to_json(F.struct(F.col("folder").alias("id"), "title", "type", F.when(F.col("content_id") % 2 == 0, "2024-01-01").alias("dateAdded")))
    meta = F.when(F.col("content_id") % 11 == 4, F.concat(F.lit("not json {"), meta)).otherwise(meta)
    files_ = as_files(c, "metadata.json", meta).unionByName(as_files(c.where("content_id % 7 <> 3"), "content.md", F.concat(F.lit(" \n"), "text", F.lit("\n\n"))))
    path = new_path(spark, "folders")
    sinks.folder_sink(files_, path)
    return files.content_scan(spark, path).select("id", "title", "type", F.col("dateAdded").isNotNull().alias("dated"), "text")


@query("series_scan", sql("SELECT DISTINCT series_id AS id, 'series ' || series_id AS title FROM content", "content"))
def series_scan(spark, d):
    """A folder with metadata for each series."""
    rows = I.content(spark, d).select(F.col("series_id").alias("folder")).distinct()
    path = new_path(spark, "series")
    sinks.folder_sink(as_files(rows, "metadata.json", F.to_json(F.struct(F.col("folder").alias("id"), F.concat(F.lit("series "), "folder").alias("title")))), path)
    return files.series_scan(spark, path).select("id", "title")


@query("names_xml_ingest", sql("SELECT pronounced AS kana, CASE WHEN n % 2 = 0 THEN written END AS kanji, 'name ' || written || '; n' || n AS meanings FROM lexicon WHERE n % 5 <> 0", "lexicon"))
def names_xml_ingest(spark, d):
    """Lexicon entries as name XML; some have no meaning and go."""
    lex = I.lexicon(spark, d)
    one = lambda name, c: F.array(F.struct(c.alias(name)))
    details = F.when(F.col("n") % 5 != 0, F.array(F.struct(F.array(F.concat(F.lit("name "), "written"), F.concat(F.lit("n"), F.col("n").cast("string"))).alias("trans_det"))))
    entries_ = lex.select(one("reb", F.col("pronounced")).alias("r_ele"), F.when(F.col("n") % 2 == 0, one("keb", F.col("written"))).alias("k_ele"), details.alias("trans"))
    path = new_path(spark, "names")
    entries_.write.format("xml").option("rowTag", "entry").option("rootTag", "names").save(path)
    return files.names_xml_ingest(spark, path).select("kana", "kanji", F.array_join("meanings", "; ").alias("meanings"))


@query("content_sink", sql("SELECT CASE type WHEN 'story' THEN 'stories' WHEN 'music' THEN 'music' ELSE 'videos' END AS kind, count(*) AS n, count(*) FILTER (WHERE length(text) = 0 OR content_id % 50 = 7) AS n_empty FROM content GROUP BY 1", "content"))
def content_sink(spark, d):
    """Metadata and bodies as files; some bodies are empty."""
    text = F.when(F.col("content_id") % 50 == 7, "").otherwise(F.col("text"))
    c = I.content(spark, d).select(F.col("content_id").alias("id"), "title", "type", text.alias("text"))
    return sinks.content_sink(c, new_path(spark, "content"))


@query("pos_base_form", sql("SELECT word || CASE length(word) % 4 WHEN 0 THEN 'い' WHEN 1 THEN 'れ' WHEN 2 THEN 'し' ELSE '' END AS surface, word || CASE length(word) % 4 WHEN 0 THEN 'く' WHEN 1 THEN 'れる' WHEN 2 THEN 'する' ELSE '' END AS base_form FROM words", "words"))
def pos_base_form(spark, d):
    """Words with the endings and part-of-speech slots of three kinds of verbs, or of a noun."""
    case = F.length("word") % 4
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (case + 1).cast("int"))
    slots = F.array(pick("動詞", "動詞", "動詞", "名詞"), F.lit("*"), F.lit("*"), F.lit("*"), pick("五段-カ行", "下一段-ラ行", "サ行変格", "*"), pick("連用形-一般", "未然形-一般", "連用形-一般", "*"))
    rows = I.words(spark, d).select(F.concat("word", pick("い", "れ", "し", "")).alias("surface"), slots.alias("pos_tags"))
    return B.pos_base_form(rows).select("surface", "base_form")


@query("vocab_incremental", sql("SELECT content_id, word, score, frequency, ord, is_morpheme FROM vocab", "vocab"))
def vocab_incremental(spark, d):
    """Content comes in two runs: a quarter is missing in the first, and an eighth has another text then."""
    c = I.content(spark, d).select("content_id", "text")
    extract = incremental.extractor(I.lexicon(spark, d), I.char_meta(spark), I.morphemes(spark), LATIN)
    table = incremental.VocabTable(spark, new_path(spark, "vocab"), dict(c.dtypes)["content_id"], extract)
    old = F.when(F.col("content_id") % 8 == 0, F.concat(F.lit("an old text and stale words "), F.reverse("text"))).otherwise(F.col("text"))
    table.update(c.where("content_id % 4 <> 1").select("content_id", old.alias("text")))
    table.update(c)
    return table.vocabulary().select("content_id", "word", "score", "frequency", "ord", "is_morpheme")


@query("known_words_stream", sql("SELECT DISTINCT user_id, event_type AS word FROM events"))
def known_words_stream(spark, d):
    """Events come as files in two portions; the stream ends after the first and starts again from its checkpoint."""
    events = I.table(spark, d, "events").select("user_id", F.col("event_type").alias("word"), "ts")
    source, target, checkpoint = (new_path(spark, name) for name in ("events", "known", "checkpoint"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    for portion in (0, 1):
        events.where(F.pmod(F.xxhash64("user_id", "ts"), F.lit(2)) == portion).write.mode("append").parquet(source)
        incremental.collect_known_words(spark, source, schema, target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("user_id", "word")
