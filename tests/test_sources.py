"""Folders, dictionaries, backups, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lexispark.functions.profiles import JA
from lexispark.sources import files, sinks
from lexispark.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_content_scan(spark, tmp_path):
    write(tmp_path / "a" / "metadata.json", json.dumps({"id": "a", "title": "A", "type": "story", "level": "beginner"}, indent=1))
    write(tmp_path / "a" / "content.md", "  猫がいる。\n")
    write(tmp_path / "b" / "metadata.json", "{not json")
    write(tmp_path / "b" / "content.md", "x")
    write(tmp_path / "c" / "metadata.json", json.dumps({"id": "c", "title": "C"}))
    rows = files.content_scan(spark, str(tmp_path)).collect()
    assert [(r.id, r.level, r.text) for r in rows] == [("a", "beginner", "猫がいる。")]
    assert {r.id for r in files.series_scan(spark, str(tmp_path)).collect()} == {"a", "c"}
    assert files.series_scan(spark, str(tmp_path / "none")).count() == 0


def test_names_xml(spark, tmp_path):
    entry = "<entry><k_ele><keb>田中</keb></k_ele><r_ele><reb>たなか</reb></r_ele><trans><trans_det>Tanaka</trans_det></trans></entry>"
    write(tmp_path / "n.xml", f"<root>{entry}<entry><r_ele><reb>x</reb></r_ele></entry></root>")
    rows = files.names_xml_ingest(spark, str(tmp_path / "n.xml")).collect()
    assert [(r.kana, r.kanji, r.meanings) for r in rows] == [("たなか", "田中", ["Tanaka"])]


def test_backups(spark):
    whole = {"knownWords": ["水", "", None, "水"], "contentVocab": {"s1": [{"word": "雨", "score": 3}]}}
    single = {"content": {"id": "s2"}, "vocab": [{"word": "木", "meaning": "tree"}]}
    lines = spark.createDataFrame([(json.dumps(whole),), (json.dumps(single),), ("not json {{",)], "value string")
    known, vocab = files.backup_read(lines)
    assert [r.word for r in known.collect()] == ["水"]
    assert {(r.content_id, r.word, r.score) for r in vocab.collect()} == {("s1", "雨", 3), ("s2", "木", None)}


def test_snapshots(spark):
    rows = [("good", 1, 0, '{"jlptScore": 1, "highestGrade": null}'), ("good", 1, 1, "{}"), ("bad", 1, 0, '{"jlptScore": 1}'), ("worse", 1, 0, "not json {{")]
    df = spark.createDataFrame(rows, "snapshot_id string, content_id int, pos int, breakdown string")
    assert {r.snapshot_id: r.valid for r in files.vocab_cache_valid(df).collect()} == {"good": True, "bad": False, "worse": False}


def test_deck(spark):
    rows = [(1, 0, "水", "みず", "water", 5, ["ichi1"]), (2, 0, "水", "みず", "other", 5, None), (1, 1, "雨", "あめ", "rain", 0, None)]
    vocab = spark.createDataFrame(rows, "content_id int, ord int, word string, reading string, meaning string, jlpt int, priorities array<string>")
    known = spark.createDataFrame([("木",)], "word string")
    assert sorted(r.line for r in sinks.deck_lines(vocab, known).collect()) == ["水\tみず<br>water\tJLPT_N5 freq_ichi1", "雨\tあめ<br>rain\tJLPT_native"]


def test_content_scan_takes_exact_names_and_few_columns(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / name / "metadata.json", json.dumps({"id": name, "title": name.upper(), "tags": ["x"]}))
        write(tmp_path / name / "old-metadata.json", json.dumps({"id": "old"}))
        write(tmp_path / name / "my-content.md", "other")
        write(tmp_path / name / "content.md", f"text {name}")
    write(tmp_path / "c" / "transcript.md", "t")
    write(tmp_path / "c" / "metadata.json", "{}")
    scanned = files.content_scan(spark, str(tmp_path))
    assert scanned.count() == 2 and sorted(r.text for r in scanned.select("text").collect()) == ["text a", "text b"]
    assert files.series_scan(spark, str(tmp_path)).count() == 3
    assert files.content_scan(spark, str(tmp_path), "transcript.md").count() == 1


def test_content_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "story", "x", "T", "", ["n5"]), ("b", "music", "", "U", "hard", []), ("c", "video", None, "V", None, None)], "id string, type string, text string, title string, level string, tags array<string>")
    path = str(tmp_path / "out")
    for _ in range(2):
        got = {r.kind: (r.n, r.n_empty) for r in sinks.content_sink(df, path).collect()}
        assert got == {"stories": (1, 0), "music": (1, 1), "videos": (1, 1)}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    story = files.content_scan(spark, f"{path}/kind=stories").collect()
    assert [(r.id, r.title, r.level, r.tags, r.text) for r in story] == [("a", "T", None, ["n5"], "x")]
    song = files.content_scan(spark, f"{path}/kind=music", "transcript.md").collect()
    assert [(r.id, r.level, r.tags, r.text) for r in song] == [("b", "hard", None, "")]


def test_stories_are_appended_once(spark, tmp_path):
    c = spark.createDataFrame([(1, "story", "One"), (2, "story", "one!"), (3, "music", "Two"), (4, "story", "Three")], "content_id int, type string, title string")
    path = str(tmp_path / "stories")
    assert sinks.content_sink_new_only(c.where("content_id = 2"), path).count() == 1
    for _ in range(2):
        assert sorted((r.content_id, r.slug) for r in sinks.content_sink_new_only(c, path).collect()) == [(2, "one"), (4, "three")]


def test_ordered_exports(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.concat(F.lit("line "), (F.col("id") * 7 % 1000).cast("string")).alias("value")).repartition(5)
    for _ in range(2):
        sinks.ordered_export(rows, ["k"], str(tmp_path / "out"), "head")
    got = [r.value for r in sinks.read_export(spark, str(tmp_path / "out")).orderBy("n").collect()]
    assert got == ["head", *(f"line {i}" for i in range(1000))]
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == got and (tmp_path / "out" / "_SUCCESS").exists()
    sinks.ordered_export(rows.limit(0), ["k"], str(tmp_path / "none"))
    assert sinks.read_export(spark, str(tmp_path / "none")).count() == 0


def test_vocab_stream_skips_what_it_has_seen(spark, tmp_path):
    lexicon = spark.createDataFrame([("e", 0, 0, "猫", "ねこ", ["ichi1"], "cat")], "entry_id string, entry_pos int, variant_pos int, written string, pronounced string, priorities array<string>, gloss string")
    meta = spark.createDataFrame([("猫", 3, 9)], "ch string, jlpt int, grade int")
    letters = spark.createDataFrame([("ね", "particle")], "morpheme string, definition string")
    source, schema = str(tmp_path / "in"), "content_id int, text string"

    table = incremental.VocabTable(spark, str(tmp_path / "out"), "int", incremental.extractor(lexicon, meta, letters, JA))

    def run():
        incremental.vocab_stream(spark, source, schema, table, str(tmp_path / "check")).awaitTermination()
        return table.vocabulary().select("content_id", "word", "meaning").collect()

    spark.createDataFrame([(1, "猫ね")], schema).write.mode("append").parquet(source)
    assert {(r.content_id, r.word, r.meaning) for r in run()} == {(1, "猫ね", "Unknown meaning")}
    spark.createDataFrame([(2, "猫")], schema).write.mode("append").parquet(source)
    assert {(r.content_id, r.word, r.meaning) for r in run()} == {(1, "猫ね", "Unknown meaning"), (2, "猫", "cat")}


def test_known_words_stream(spark, tmp_path):
    df = spark.sql("SELECT 1 AS user_id, 'a' AS word, timestamp'2024-01-01' AS ts UNION ALL SELECT 1, 'a', timestamp'2024-01-01'")
    df.write.parquet(str(tmp_path / "in"))
    stream = incremental.known_words_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("known").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("known").count() == 1


def test_known_words_stream_takes_late_events_and_no_repeats(spark, tmp_path):
    schema, source = "user_id int, word string, ts timestamp", str(tmp_path / "in")
    event = lambda word, day: f"SELECT 1 AS user_id, '{word}' AS word, timestamp'2024-01-{day:02}' AS ts"
    spark.sql(event("a", 1)).write.parquet(source)
    stream = incremental.known_words_stream(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("known_late").outputMode("append").start()
    try:
        q.processAllAvailable()
        for word, day in (("b", 10), ("late", 2), ("a", 11), ("c", 20), ("b", 21), ("late", 22)):
            spark.sql(event(word, day)).write.mode("append").parquet(source)
            q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.word for r in spark.table("known_late").collect()) == ["a", "b", "c", "late"]


def test_folders_on_a_local_path_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds neither names nor sizes of files: Spark's own listing of files isn't asked for."""
    from pyspark.sql.readwriter import DataFrameReader

    from lexispark.sources import small_files

    plain = DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, source: plain(self, source) if source != "binaryFile" else pytest.fail("listed by the driver"))
    rows = [(i, f"title {i}", ("story", "music", "video")[i % 3], "" if i % 5 == 0 else f"text é {i}") for i in range(60)]
    content = spark.createDataFrame(rows, "id bigint, title string, type string, text string")
    path = str(tmp_path / "sink")
    assert {r.kind: (r.n, r.n_empty) for r in sinks.content_sink(content, path).collect()} == {"stories": (20, 4), "music": (20, 4), "videos": (20, 4)}
    scanned = files.content_scan(spark, f"{path}/kind=stories").select("id", "text").collect()
    assert {(r.id, r.text) for r in scanned} == {(str(i), t) for i, _, kind, t in rows if kind == "story"}

    deep = tmp_path / "deep" / "a b" / "c%20d" / "é"
    deep.mkdir(parents=True)
    for name in ("metadata.json", "other.md", "part-7", ".part-8", "_metadata.json"):
        (deep / name).write_bytes(b"x\xff")
    (tmp_path / "deep" / "_hidden").mkdir()
    (tmp_path / "deep" / "_hidden" / "metadata.json").write_text("{}")
    found = small_files.read_files(small_files.list_files(spark, str(tmp_path / "deep"), "metadata.json")).collect()
    assert {(r.path, bytes(r.content)) for r in found} == {(str(deep / name), b"x\xff") for name in ("metadata.json", "part-7")}
