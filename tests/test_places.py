"""Counts and places of tokens by text, and vocabulary of words that are chosen before they meet the texts."""

import pyarrow as pa

from lexispark.functions.profiles import JA, LATIN
from lexispark.operators import places as P
from lexispark.operators import tokens as K
from lexispark.operators import vocab as V

TEXTS = [(1, "The cat.\n\nthe Là dog"), (1, "a cat"), (2, None), (3, "\U0001f600 é é\nthe"), (None, "cat the")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_those_of_the_tokens(spark):
    for texts in (TEXTS, TEXTS[1:]):  # ids that repeat, and not
        content = spark.createDataFrame(texts, "content_id bigint, text string")
        want = V.surface_counts(K.tokenize(content, LATIN))
        got = V.run_surfaces(content, LATIN)
        assert rows(got.select(want.columns)) == rows(want)
        assert rows(P.run_totals(content, LATIN)) == rows(K.tokenize(content, LATIN).groupBy("surface").count())


def test_texts_with_ids_of_their_own_are_counted_without_a_shuffle_of_tokens(spark):
    content = spark.createDataFrame(TEXTS[1:], "content_id bigint, text string")
    assert "Exchange" not in plan(V.run_surfaces(content, LATIN))
    assert "Exchange" not in plan(P.run_places(content, LATIN))


def test_places_and_lines(spark):
    content = spark.createDataFrame(TEXTS[1:], "content_id bigint, text string")
    got = rows(P.run_places(content, LATIN).where("content_id = 3"))
    assert got == [(3, 0, "é", 2, 3, 0), (3, 1, "é", 4, 5, 0), (3, 2, "the", 6, 9, 1)]
    text = spark.createDataFrame([(5, "食べる、食べる\n水")], "content_id bigint, text string")
    spans = K.token_offsets(text, K.tokenize(text, JA))
    assert rows(P.run_places(text, JA).drop("line_no")) == rows(spans)


ODD = ["", None, "a", "é", "aé", "éa b", "1a2é3", "\n\na\nb", "x\U0001d400y \U0001f600z", "ÀÉ ß ŒØ", "日本 語a", "I\u0307İi ǅ", "e\u0301a", "ab", "١٢ عربي", "\u2028a\u00a0b", "ends"]


def test_runs_are_cut_as_by_the_regular_expression(spark, monkeypatch):
    import random
    import re

    rng = random.Random(1)
    texts = list(enumerate(ODD + ["".join(rng.choices("aé \n\U0001d400日-", k=rng.randrange(40))) for _ in range(200)]))
    content = spark.createDataFrame(texts, "content_id bigint, text string").coalesce(2)
    of = lambda: [P.run_places(content, LATIN), P.run_counts(content, LATIN), P.run_totals(content, LATIN)]
    monkeypatch.setattr(P, "BYTES", 100)
    cut = of()
    assert not any("regexp_extract_all" in plan(df) for df in cut)
    got = [rows(df) for df in cut]
    monkeypatch.setattr(P, "ONE_CLASS", re.compile("never"))
    assert got == [rows(df) for df in of()]


def test_slices_bound_what_is_counted_together(monkeypatch):
    monkeypatch.setattr(P, "TOKENS", 3)
    batch = pa.RecordBatch.from_pydict({"content_id": pa.array([1, 2, 3]), "runs": pa.array([["a", "b", "a"], None, ["b"] * 5])})
    got = [tuple(r.values()) for part in P.text_counts(iter([batch])) for r in part.to_pylist()]
    assert sorted(got) == [(1, "a", 2, 0), (1, "b", 1, 1), (3, "b", 5, 0)]


def test_exports_are_read_line_by_line(spark, tmp_path):
    from lexispark.sources import sinks

    path = str(tmp_path / "out")
    lines = spark.range(3000).selectExpr("id AS content_id", "concat('{', id, '}') AS value").repartition(3)
    sinks.write_lines(lines, path)
    read = sinks.read_export(spark, path)
    assert "wholetext" not in plan(read) and max(len(r.value) for r in read.collect()) < 10
    assert [r.value for r in read.orderBy("n").collect()] == [f"{{{i}}}" for i in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        sinks.ordered_export(lines, ["content_id"], path)  # plain parts, of many blocks
        assert [r.value for r in sinks.read_export(spark, path).orderBy("n").collect()] == [f"{{{i}}}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_backups_are_dealt_before_they_are_collected(spark):
    from lexispark.sources import sinks

    vocab = spark.createDataFrame([(1, 1, "b", "b", "m", 2), (1, 0, "a", "a", "m", 1)], "content_id bigint, ord int, word string, reading string, meaning string, score int")
    lines = sinks.backup_lines(vocab)
    assert lines.first().value.index('"a"') < lines.first().value.index('"b"')
    final = plan(lines)
    assert final.index("partial_collect_list") < final.index("Exchange")  # printed from the top: the exchange lies below both aggregates


def test_small_files_lie_as_sparks_writer_lays_them(spark, tmp_path):
    from lexispark.sources import sinks
    from lexispark.sources.small_files import write_files

    rows = spark.createDataFrame([("a b", "x.md", "one"), ("a b", "x.md", "two\nlines"), ("a/ü:%", "y.md", None), (None, "x.md", "")], "folder string, file string, value string")
    rows = rows.coalesce(1).sortWithinPartitions("folder", "file", "value")
    rows.write.partitionBy("folder", "file").text(str(tmp_path / "spark"))
    write_files(rows, str(tmp_path / "own"), ("folder", "file"))
    found = lambda root: {(str(p.parent.relative_to(root)), p.read_bytes()) for p in root.rglob("part-*")}
    assert found(tmp_path / "own") == found(tmp_path / "spark")
    sinks.folder_sink(rows, str(tmp_path / "sink"))
    assert found(tmp_path / "sink") == found(tmp_path / "spark")
    assert all(p.name == "part-00000.txt" for p in (tmp_path / "sink").rglob("part-*"))  # not one writer of Spark for each


def test_each_key_is_looked_up_once(spark):
    words = spark.createDataFrame([("là", "la"), ("la", "la"), ("été", "ete"), ("x", None)], "word string, base_form string")
    entry = lambda w, p: (w, 0, 0, w, p, ["ichi1"], f"gloss of {w}")
    lexicon = spark.createDataFrame([entry("là", "la"), entry("été", "e")], "entry_id string, entry_pos int, variant_pos int, written string, pronounced string, priorities array<string>, gloss string")
    meta = spark.createDataFrame([("é", 5, 1)], "ch string, jlpt int, grade int")
    scored = V.score_words(words, lexicon, meta, LATIN)
    assert plan(scored).count("partial_max_by") == 1
    got = {r.word: (r.reading, r.meaning, r.jlpt, r.joyo) for r in scored.collect()}
    assert got == {"là": ("la", "gloss of là", 0, False), "la": ("la", "gloss of là", 5, True), "été": ("e", "gloss of été", 5, True), "x": ("x", "Unknown meaning", 5, True)}


def test_missing_words_are_added_up_before_they_are_looked_up(spark):
    from lexispark.operators import content as C
    from lexispark.operators import reports as R

    counts = spark.createDataFrame([(1, "là", "la", 2, 0), (2, "là", "la", 1, 0), (2, "lä", "la", 4, 1), (2, "b", "b", 1, 2)], "content_id bigint, word string, base_form string, frequency bigint, ord int")
    lexicon = spark.createDataFrame([("b", "b")], "written string, pronounced string")
    assert rows(R.missing_counts(counts, lexicon)) == rows(R.missing_words(counts, lexicon, LATIN).select("base_form", "n")) == [("la", 7)]
    vocab = spark.createDataFrame([(1, "a", "r", "m", 1)], "content_id bigint, word string, reading string, meaning string, score int")
    merged = C.vocab_merge(vocab, vocab.withColumn("seq", C.F.lit(1)), order="seq")
    assert "keys=[word" in plan(merged).replace("key=[", "keys=[")  # in the order of words, in which equal values lie together


def test_groups_are_the_counts_by_word(spark, monkeypatch):
    for texts in (TEXTS, TEXTS[1:]):  # ids that repeat, and not
        content = spark.createDataFrame(texts, "content_id bigint, text string").coalesce(1)
        for tokens in (2_000_000, 3):
            monkeypatch.setattr(P, "TOKENS", tokens)
            groups, counts = P.run_groups(content, LATIN), P.run_counts(content, LATIN)
            assert rows(P.ungrouped(groups).select(counts.columns)) == rows(counts)
            assert rows(groups.groupBy("surface").sum("n")) == rows(P.run_totals(content, LATIN))
            first = counts.groupBy("surface").agg(P.F.min(P.F.struct("content_id", "ord")).alias("f"))
            assert rows(P.ungrouped(P.first_places(groups)).groupBy("surface").agg(P.F.min(P.F.struct("content_id", "ord")).alias("f"))) == rows(first)
            parts = groups.select("part", P.F.explode("content_ids").alias("id")).distinct()
            assert parts.groupBy("id").count().where("count > 1").isEmpty()  # a part has whole texts
    monkeypatch.setattr(P, "TOKENS", 2_000_000)
    assert P.run_groups(content, LATIN).where("surface = 'the'").count() == 1 < counts.where("surface = 'the'").count()


def test_words_meet_groups_before_these_are_unfolded(spark):
    content = spark.createDataFrame(TEXTS[1:], "content_id bigint, text string")
    scored = spark.createDataFrame([("the", "r", "m", 5, True, 7), ("é", "r", "m", 5, True, 9), ("cat", "r", "m", 5, True, 1)], "word string, reading string, meaning string, jlpt int, joyo boolean, score int")
    singles = V.single_words(spark.createDataFrame([("a", "Indefinite")], "morpheme string, definition string"))
    flat = V.vocab_from(V.run_surfaces(content, LATIN), scored, singles, LATIN)
    dealt = V.vocab_from(P.run_groups(content, LATIN), scored, singles, LATIN, by_part=True)
    assert rows(dealt) == rows(flat) and dealt.where("is_morpheme").count() == 1
    final = plan(dealt.groupBy("content_id").sum("score"))  # printed from the top
    assert final.count("Join") == 1
    assert all("MapInArrow" in line for line in final.splitlines() if "frequencies" in line)  # only what is asked for goes along
    assert final.index("partial_sum") < final.index("Generate posexplode") < final.index("hashpartitioning(part") < final.index("Join")


def test_scores_ask_the_lexicon_once_and_characters_not_at_all(spark):
    words = spark.createDataFrame([("là", "la"), ("x", None)], "word string, base_form string")
    lexicon = spark.createDataFrame([("là", 0, 0, "là", "la", ["ichi1"], "g"), ("n", 0, 0, None, "x", ["ichi1"], "h")], "entry_id string, entry_pos int, variant_pos int, written string, pronounced string, priorities array<string>, gloss string")
    scored = V.score_words(words, lexicon, spark.createDataFrame([("é", 5, 1)], "ch string, jlpt int, grade int"), LATIN)
    assert plan(scored).count("Join") == 3  # words with the best variants, their characters with levels, both
    assert rows(scored.select("word", "meaning")) == [("là", "g"), ("x", "Unknown meaning")]
