"""Inputs of the registered queries, derived from the given tables by Spark, and the same derivations as SQL.

The given tables hold Latin-script texts, so queries use the LATIN profile: accented letters are the complex characters, the
lexicon is made from word counts over all documents, known words are those of user turns in conversations."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions.profiles import ACCENTS, LATIN, PLAIN
from lexispark.operators import content as C
from lexispark.operators import tokens as K
from lexispark.operators import vocab as V
from lexispark.operators import places as P
from lexispark.sources.staging import staged as written
from lexispark.sources.stored import remove

#: What groups can be asked for.
ALL = ("frequencies", "ords")
#: Tables that the running query has written, by name and folder of the inputs. Each query, in each thread, has its own.
_made: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("made", default=None)
_shared: ContextVar[bool] = ContextVar("shared", default=False)


def fresh(query):
    """query with tables of its own, which its branches share; inside shared_inputs with those made there before."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _shared.get():
            return query(spark, sf_dir)
        before = _made.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _made.reset(before)

    return run


@contextmanager
def shared_inputs() -> Iterator[None]:
    """Queries inside read the same derived tables, whose files are removed at its end."""
    made, shared = _made.set({}), _shared.set(True)
    try:
        yield
    finally:
        for table in _made.get().values():
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                remove(table.sparkSession, folder)
        _made.reset(made)
        _shared.reset(shared)


def once(name: str):
    """A derived table that is written when a query first asks for it."""

    def wrap(make):
        @functools.wraps(make)
        def table_of(spark: SparkSession, sf_dir: str, *asked: str) -> DataFrame:
            made, key = _made.get(), ("-".join((name, *asked)), sf_dir)
            if made is None:
                return make(spark, sf_dir, *asked)
            if key not in made:
                made[key] = written(make(spark, sf_dir, *asked), name)
            return made[key]

        return table_of

    return wrap


# Level and grade of complex letters, their repetition stages, meanings of single letters.
CHAR_META = (("é", 5, 1), ("è", 4, 2), ("à", 3, 3), ("ç", 2, 4), ("ê", 1, 5), ("ä", 5, 6), ("ö", 4, 8), ("ü", 3, 9), ("ß", 2, 10), ("ñ", 1, None), ("í", None, 1), ("ó", None, None))
SRS = (("é", 8), ("è", 3), ("ö", 5), ("ä", 7), ("ñ", 1), ("ç", 9))
MORPHEMES = (("a", "Indefinite"), ("y", "Conjunction"), ("à", "Preposition"), ("ç", "Stem"), ("ö", "Stem variation"), ("é", "Ending"), ("ü", "Connection"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "story").when(F.col("doc_id") % 3 == 1, "music").otherwise("video")
    title = F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), "text", "lang", F.col("source").alias("series_id"), kind.alias("type"), title.alias("title"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = content(spark, sf_dir), F.col("content_id") % 5
    return c.select("content_id", "title", "series_id", (F.col("content_id") - r).alias("parent_id"), F.when(r == 4, "easy").alias("variant_type"), F.when((r > 0) & (r < 4), r.cast("int")).alias("episode"), F.when(r == 0, F.array(F.col("content_id") + 5)).otherwise(F.array().cast("array<bigint>")).alias("related"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tokenize(content(spark, sf_dir), LATIN)


@once("surfaces")
def groups(spark: SparkSession, sf_dir: str, *asked: str) -> DataFrame:
    """The distinct surfaces of each part of the texts with their texts and what is asked of these (frequencies, ords), for all that follows
    by text: a query writes no more than it reads. "first" asks for the first text of each part alone."""
    return P.run_groups(content(spark, sf_dir), LATIN, ("content_ids", *[c for c in asked if c != "first"]), "first" in asked)


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's distinct surfaces with counts."""
    return P.ungrouped(groups(spark, sf_dir, *ALL)).select("content_id", "surface", "frequency", "ord")


@once("totals")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surface of all texts with its number: lexicon and words need no counts by text."""
    for (name, of), cut in (_made.get() or {}).items():
        if name.startswith("surfaces") and of == sf_dir:
            return cut.groupBy("surface").agg(F.sum("n").alias("n"))
    return P.run_totals(content(spark, sf_dir), LATIN)


@once("lexicon")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = totals(spark, sf_dir).withColumnRenamed("surface", "written")
    counts = counts.where(~F.substring(F.md5("written"), 1, 1).isin("0", "1")).withColumn("pronounced", K.base_form(F.col("written")))
    n = F.col("n")
    tag = F.when(n >= 500, "ichi1").when(n >= 200, "news2").when(n >= 100, "gai1").when(n >= 50, "spec2").when(n >= 2, F.concat(F.lit("nf"), F.lpad((50 - n).cast("string"), 2, "0")))
    order = W.partitionBy("pronounced").orderBy(n.desc(), "written")
    return counts.select(F.col("written").alias("entry_id"), (F.row_number().over(order) - 1).alias("entry_pos"), F.lit(0).alias("variant_pos"), "written", "pronounced", F.when(tag.isNotNull(), F.array(tag)).otherwise(F.array().cast("array<string>")).alias("priorities"), F.concat(F.lit("gloss of "), "written").alias("gloss"), "n")


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LATIN.token), F.lit(0))).alias("word")).distinct()


def fixed(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def char_meta(spark: SparkSession) -> DataFrame:
    return fixed(spark, CHAR_META, "ch string, jlpt int, grade int")


def srs(spark: SparkSession) -> DataFrame:
    return fixed(spark, SRS, "ch string, stage int")


def morphemes(spark: SparkSession) -> DataFrame:
    return fixed(spark, MORPHEMES, "morpheme string, definition string")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counted_words(V.with_base(surfaces(spark, sf_dir), LATIN), LATIN)


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words (word, base_form) with their numbers in all texts."""
    surface = totals(spark, sf_dir).select("surface", K.base_form(F.col("surface")).alias("base_form"), F.col("n").alias("frequency"))
    return V.kept_words(surface, LATIN).withColumnRenamed("surface", "word")  # totals has a row for each surface


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_totals(spark, sf_dir).select("word", "base_form")


@once("scored")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words with what their lookups and scores come to."""
    return V.score_words(words(spark, sf_dir), lexicon(spark, sf_dir), char_meta(spark), LATIN)


def vocab(spark: SparkSession, sf_dir: str, in_order: bool = False, by_part: bool = False, asked: tuple[str, ...] = ALL, own: tuple[str, ...] = ()) -> DataFrame:
    return V.vocab_with(groups(spark, sf_dir, *asked), scored(spark, sf_dir), morphemes(spark), LATIN, in_order, by_part, own)


def vocab_where(spark: SparkSession, sf_dir: str, choose: Callable[[DataFrame], DataFrame], by_part: bool = False, asked: tuple[str, ...] = ALL) -> DataFrame:
    """The vocabulary of the words that choose takes or changes: it sees each distinct word once, before these meet the texts.

    by_part is for what is gathered by text; asked is what groups has of each text."""
    rows = groups(spark, sf_dir, *asked)
    return V.vocab_from(rows, choose(scored(spark, sf_dir)), choose(V.single_words(morphemes(spark))), LATIN, by_part=by_part)


def seen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the vocabulary (word), defined single letters included."""
    letters = totals(spark, sf_dir).select(F.col("surface").alias("word")).join(F.broadcast(V.single_words(morphemes(spark)).select("word")), "word", "left_semi")
    return words(spark, sf_dir).select("word").unionByName(letters)


def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first place of each word needs: content_id, word and ord of its first text in each part, without its scores."""
    return V.vocab_places(P.ungrouped(groups(spark, sf_dir, "ords", "first")), morphemes(spark), LATIN)


def unknown(spark: SparkSession, sf_dir: str, by_part: bool = False, asked: tuple[str, ...] = ALL) -> DataFrame:
    known = known_words(spark, sf_dir)
    return vocab_where(spark, sf_dir, lambda words: V.unknown_anti(words, known), by_part, asked)


def known(spark: SparkSession, sf_dir: str, by_part: bool = False, asked: tuple[str, ...] = ALL) -> DataFrame:
    known = known_words(spark, sf_dir)
    return vocab_where(spark, sf_dir, lambda words: V.known_semi(words, known), by_part, asked)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_where(spark, sf_dir, lambda words: V.with_srs(words, srs(spark), LATIN), asked=())


def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known words of an advanced learner: those of conversations and all that the lexicon has seen twice."""
    return C.known_union(known_words(spark, sf_dir), lexicon(spark, sf_dir).where("n >= 2").select(F.col("written").alias("word")))


def status(spark: SparkSession, sf_dir: str, known: DataFrame | None = None, asked: tuple[str, ...] = ()) -> DataFrame:
    """content_status; asked is for queries that read the same groups for more."""
    known = known_words(spark, sf_dir) if known is None else known
    marked = vocab_where(spark, sf_dir, lambda words: V.marked_known(V.with_srs(words, srs(spark), LATIN), known), by_part=True, asked=asked)
    return V.status_of(content(spark, sf_dir), marked)


def by_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return content(spark, sf_dir).where(F.col("type") == kind)


def all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.content_all(*[by_type(spark, sf_dir, t) for t in ("story", "music", "video")])


def values(rows: tuple, columns: str) -> str:
    def literal(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def best_of(source: str, key: str) -> str:
    """SQL of the best variant for each key of a derived table."""
    return f"""(SELECT k, written, pronounced, tag, gloss, vs FROM (
    SELECT k, l.*, vs, row_number() OVER (PARTITION BY k ORDER BY vs DESC, entry_pos) rn FROM (
      SELECT k, l.*, (CASE WHEN written = k THEN 100 ELSE 0 END) + (CASE WHEN tag IS NOT NULL THEN 50 ELSE 0 END)
        + (CASE WHEN written <> k AND regexp_matches(k, '^[a-z]+$') AND regexp_matches(written, '[à-öø-ÿß]') THEN CASE WHEN tag IS NOT NULL THEN -20 ELSE -200 END ELSE 0 END)
        + (CASE WHEN tag IN ('ichi1', 'news1') THEN 1000 WHEN tag IN ('ichi2', 'news2') THEN 500 ELSE 0 END) + greatest(0, 50 - entry_pos) vs
      FROM (SELECT s.k, l.* FROM (SELECT DISTINCT {key} k FROM {source}) s JOIN lexicon l ON l.written = s.k
            UNION ALL SELECT s.k, l.* FROM (SELECT DISTINCT {key} k FROM {source}) s JOIN lexicon l ON l.pronounced = s.k AND l.written <> l.pronounced) l) l
    WHERE vs >= 0) WHERE rn = 1)"""


FREQ = """CASE WHEN {v} IS NULL THEN CASE WHEN regexp_matches({w}, '^[a-z]{{1,3}}$') THEN -20 ELSE 50 END
    WHEN {t} IN ('ichi1', 'news1') THEN -20 WHEN {t} IN ('ichi2', 'news2') THEN -10 WHEN {t} IN ('gai1', 'spec1') THEN 0 WHEN {t} IN ('gai2', 'spec2') THEN 5
    WHEN {t} LIKE 'nf%' THEN CASE WHEN substr({t}, 3)::INT <= 5 THEN 10 WHEN substr({t}, 3)::INT <= 10 THEN 15 WHEN substr({t}, 3)::INT <= 20 THEN 20 WHEN substr({t}, 3)::INT <= 30 THEN 30 ELSE 40 END
    ELSE 50 END"""

#: Derived tables in order of dependence.
CTE = {
    "content": "SELECT doc_id AS content_id, text, lang, source AS series_id, CASE doc_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'music' ELSE 'video' END AS type, source || ' ' || lang || ' ' || doc_id AS title FROM documents",
    "relations": "SELECT content_id, title, series_id, content_id - content_id % 5 AS parent_id, CASE WHEN content_id % 5 = 4 THEN 'easy' END AS variant_type, CASE WHEN content_id % 5 BETWEEN 1 AND 3 THEN content_id % 5 END AS episode, CASE WHEN content_id % 5 = 0 THEN content_id + 5 END AS related FROM content",
    "tokens": f"SELECT content_id, pos, surface, translate(surface, '{ACCENTS}', '{PLAIN}') AS base_form FROM (SELECT content_id, unnest(ws) AS surface, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT content_id, regexp_extract_all(lower(text), '\\p{{L}}+') ws FROM content))",
    "lexicon": f"SELECT written AS entry_id, written, pronounced, n, 'gloss of ' || written AS gloss, row_number() OVER (PARTITION BY pronounced ORDER BY n DESC, written) - 1 AS entry_pos, CASE WHEN n >= 500 THEN 'ichi1' WHEN n >= 200 THEN 'news2' WHEN n >= 100 THEN 'gai1' WHEN n >= 50 THEN 'spec2' WHEN n >= 2 THEN 'nf' || lpad((50 - n)::VARCHAR, 2, '0') END AS tag FROM (SELECT surface AS written, translate(surface, '{ACCENTS}', '{PLAIN}') AS pronounced, count(*) AS n FROM tokens GROUP BY surface) WHERE substr(md5(written), 1, 1) NOT IN ('0', '1')",
    "known": "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM conversations WHERE role = 'user'",
    "char_meta": values(CHAR_META, "ch, jlpt, grade"),
    "srs": values(SRS, "ch, stage"),
    "morphemes": values(MORPHEMES, "morpheme, definition"),
    "counts": "SELECT content_id, surface AS word, arg_max(base_form, pos) AS base_form, count(*) AS frequency, min(pos) AS ord FROM tokens WHERE length(surface) > 1 GROUP BY content_id, surface",
    "words": "SELECT word, min(base_form) AS base_form FROM counts GROUP BY word",
    "chars": "SELECT word, ch, i FROM (SELECT word, unnest(cs) AS ch, generate_subscripts(cs, 1) - 1 AS i FROM (SELECT word, regexp_extract_all(word, '[à-öø-ÿß]') cs FROM words))",
    "profile": "SELECT word, CASE WHEN hg IS NULL THEN 5 ELSE coalesce(mj, 0) END AS jlpt, hg AS highest_grade, coalesce(joyo, true) AS joyo, coalesce(lv, '') AS jlpt_values FROM words LEFT JOIN (SELECT word, min(jlpt) mj, max(CASE WHEN grade <= 8 THEN grade ELSE 9 END) hg, bool_and(coalesce(grade, 99) <= 8) joyo, string_agg(coalesce(jlpt, 0)::VARCHAR, ',' ORDER BY i) lv FROM chars LEFT JOIN char_meta USING (ch) GROUP BY word) USING (word)",
    "best_surface": best_of("words", "word"),
    "best_base": best_of("words", "base_form"),
    "scored": f"""SELECT word, coalesce(b.pronounced, s.pronounced, word) AS reading, coalesce(b.gloss, s.gloss, 'Unknown meaning') AS meaning, jlpt, joyo, highest_grade, freq_penalty,
    greatest(1, least(100, (CASE jlpt WHEN 5 THEN 15 WHEN 4 THEN 30 WHEN 3 THEN 50 WHEN 2 THEN 70 WHEN 1 THEN 90 ELSE 100 END) + (CASE coalesce(highest_grade, 0) WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 10 WHEN 4 THEN 12 WHEN 5 THEN 15 WHEN 6 THEN 20 WHEN 8 THEN 25 WHEN 9 THEN 30 ELSE 0 END) + freq_penalty)) AS score
    FROM (SELECT *, {FREQ.format(v="v", t="t", w="word")} AS freq_penalty FROM (SELECT w.word, w.base_form, coalesce(b.written, s.written) v, CASE WHEN b.written IS NOT NULL THEN b.tag ELSE s.tag END t FROM words w LEFT JOIN best_surface s ON s.k = w.word LEFT JOIN best_base b ON b.k = w.base_form)) w
    LEFT JOIN best_surface s ON s.k = w.word LEFT JOIN best_base b ON b.k = w.base_form JOIN profile p USING (word)""",
    "vocab": "SELECT content_id, word, reading, meaning, jlpt, joyo, score, frequency, ord, false AS is_morpheme FROM counts JOIN scored USING (word) UNION ALL SELECT content_id, surface, surface, any_value(definition), 0, false, 0, count(*), min(pos), true FROM tokens JOIN morphemes ON morpheme = surface GROUP BY content_id, surface",
    "stages": "SELECT w.word, min(stage) AS stage FROM (SELECT DISTINCT word FROM vocab) w LEFT JOIN (SELECT DISTINCT word, unnest(regexp_extract_all(word, '[à-öø-ÿß]')) AS ch FROM vocab) c ON c.word = w.word LEFT JOIN srs USING (ch) GROUP BY w.word",
    "staged": "SELECT v.* EXCLUDE (score), score AS base_score, stage, CASE WHEN stage IS NULL THEN score ELSE greatest(1, floor(score * (CASE stage WHEN 1 THEN 0.95 WHEN 2 THEN 0.90 WHEN 3 THEN 0.80 WHEN 4 THEN 0.70 WHEN 5 THEN 0.50 WHEN 6 THEN 0.35 WHEN 7 THEN 0.25 WHEN 8 THEN 0.15 WHEN 9 THEN 0.05 ELSE 1.0 END)::DOUBLE + 0.5)::INT) END AS score FROM vocab v JOIN stages USING (word)",
    "status": """SELECT content_id, coalesce(total_count, 0) AS total_count, coalesce(unknown_count, 0) AS unknown_count, coalesce(tus, 0) AS total_unknown_score, coalesce(ss, 0.0) AS status_score,
    CASE WHEN coalesce(unknown_count, 0) = 0 THEN 0 ELSE floor(tus / unknown_count + 0.5)::BIGINT END AS difficulty,
    CASE WHEN coalesce(total_count, 0) = 0 THEN 0 ELSE floor((total_count - unknown_count) * 100.0::DOUBLE / total_count + 0.5)::BIGINT END AS comprehension
    FROM content LEFT JOIN (SELECT content_id, count(*) total_count, count(*) FILTER (NOT kn) unknown_count, coalesce(sum(score) FILTER (NOT kn), 0) tus, sum(CASE WHEN NOT kn OR stage IS NOT NULL THEN score * 1.0::DOUBLE ELSE score * 0.5::DOUBLE END) ss
      FROM (SELECT *, (word IN (SELECT word FROM known) OR coalesce(stage >= 7, false)) kn FROM staged) GROUP BY content_id) USING (content_id)""",
    "looked": "SELECT c.*, (a.key IS NOT NULL OR b.key IS NOT NULL) AS found FROM counts c LEFT JOIN (SELECT written AS key FROM lexicon UNION SELECT pronounced FROM lexicon) a ON a.key = c.word LEFT JOIN (SELECT written AS key FROM lexicon UNION SELECT pronounced FROM lexicon) b ON b.key = c.base_form",
}
CTE["keys"] = "SELECT written AS key FROM lexicon UNION SELECT pronounced FROM lexicon"
CTE["known_adv"] = "SELECT word FROM known UNION SELECT written FROM lexicon WHERE n >= 2"
CTE["status_adv"] = CTE["status"].replace("FROM known)", "FROM known_adv)")
NEEDS = {
    "keys": ["lexicon"],
    "known_adv": ["known", "lexicon"], "status_adv": ["content", "staged", "known_adv"],
    "relations": ["content"], "tokens": ["content"], "lexicon": ["tokens"], "counts": ["tokens"], "words": ["counts"], "chars": ["words"],
    "profile": ["words", "chars", "char_meta"], "best_surface": ["words", "lexicon"], "best_base": ["words", "lexicon"],
    "scored": ["words", "best_surface", "best_base", "profile"], "vocab": ["counts", "scored", "tokens", "morphemes"],
    "stages": ["vocab", "srs"], "staged": ["vocab", "stages"], "status": ["content", "staged", "known"], "looked": ["counts", "lexicon"],
}


def sql(body: str, *needs: str) -> str:
    """body with the derived tables that it needs in front."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for n in NEEDS.get(name, []):
                add(n)

    for n in needs:
        add(n)
    if not wanted:
        return body
    start = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    body = body.removeprefix("WITH RECURSIVE ")
    tables = ",\n".join(f"{k} AS MATERIALIZED ({CTE[k]})" for k in CTE if k in wanted)
    return f"{start}{tables}{',' if start != 'WITH ' else ''}\n{body}"
