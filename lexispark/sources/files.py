"""Reading content folders, dictionaries, names, backups and repetition stages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.small_files import list_files, read_files
from lexispark.sources.staging import staged
from lexispark.sources.stored import exists, local_folder

META = "id string, title string, type string, description string, level string, author string, artist string, creator string, imageUrl string, mediaUrl string, parentId string, seriesId string, episodeNumber int, variantType string, dateAdded string, tags array<string>, relatedStories array<struct<id:string,type:string,description:string>>, _corrupt_record string"
META_COLUMNS = re.split(r", (?=\w+ )", META.removesuffix(", _corrupt_record string"))
WORD_ENTRY = "id string, kanji array<struct<text:string,common:boolean>>, kana array<struct<text:string,common:boolean>>, sense array<struct<gloss:array<struct<lang:string,text:string>>>>"
VOCAB = "array<struct<word:string,reading:string,meaning:string,score:int>>"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Jobs inside put as many small files into a task as their bytes allow, not a few dozen."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "64k")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def packed_files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """Files with exactly these names in the folders below root -> folder, file, value, written once as one table.

    A file lies in its folder by its own name, or, as Spark's writers leave it, in parts in a folder of that name (folder=a/file=b/part-0).
    On a shared local path tasks list and read them, elsewhere Spark's reader, whose driver holds the names of all. Whatever follows reads
    the table."""
    if local := local_folder(spark, root):
        found = read_files(list_files(spark, local, *names))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{','.join(names)},part-*}}").load(root)
    place = rf"(?:^|/)(?:[^/=]+=)?([^/=]+)/(?:file=)?({'|'.join(re.escape(n) for n in names)})(?:/part-[^/]*)?$"
    rows = found.select(F.regexp_extract("path", place, 1).alias("folder"), F.regexp_extract("path", place, 2).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
    with small_files(spark):
        return staged(rows.where("file <> ''"), "files")


def parsed_metadata(rows: DataFrame) -> DataFrame:
    """value (JSON) -> the other columns and those of META; rows that don't parse go."""
    others = [c for c in rows.columns if c != "value"]
    doc = F.from_json("value", META, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.select(*others, doc.alias("_d")).where("_d IS NOT NULL AND _d._corrupt_record IS NULL").select(*others, "_d.*").drop("_corrupt_record")


def content_scan(spark: SparkSession, root: str, body: str = "content.md") -> DataFrame:
    """Folders with metadata.json and a body: both must exist and the JSON must parse; bodies are trimmed."""
    found = packed_files(spark, root, "metadata.json", body)
    value = lambda name: F.max(F.when(F.col("file") == name, F.col("value")))
    both = found.groupBy("folder").agg(value("metadata.json").alias("value"), value(body).alias("text")).where("value IS NOT NULL AND text IS NOT NULL")
    trimmed = F.regexp_replace("text", r"^[\s　]+|[\s　]+$", "").alias("text")
    return parsed_metadata(both.select("value", trimmed)).select(*[c.split()[0] for c in META_COLUMNS], "text")


def series_scan(spark: SparkSession, root: str) -> DataFrame:
    """Folders that need metadata only; a missing root gives an empty table of the same schema."""
    if not exists(spark, root):
        return spark.createDataFrame([], ", ".join(META_COLUMNS))
    return parsed_metadata(packed_files(spark, root, "metadata.json").select("value"))


def names_xml_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Name dictionary XML: the first reading and writing and all meanings of each entry; entries without either of reading and meaning go."""
    schema = "r_ele array<struct<reb:string>>, k_ele array<struct<keb:string>>, trans array<struct<trans_det:array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    meanings = F.flatten(F.transform("trans", lambda t: t["trans_det"]))
    rows = rows.select(F.get("r_ele", F.lit(0))["reb"].alias("kana"), F.get("k_ele", F.lit(0))["keb"].alias("kanji"), meanings.alias("meanings"))
    return rows.where("kana IS NOT NULL AND size(meanings) > 0")


def word_dict_entries(lines: DataFrame) -> DataFrame:
    """JSON lines (value) of word entries -> entry_id, written, pronounced, n_kanji, n_senses and senses (arrays of English glosses, else the first)."""
    e = F.from_json("value", WORD_ENTRY)
    rows = lines.select(e.alias("e")).where("e.id IS NOT NULL")

    def glosses(s):
        english = F.transform(F.filter(s["gloss"], lambda g: g["lang"] == "en"), lambda g: g["text"])
        return F.when(F.size(english) > 0, english).otherwise(F.array(F.get(s["gloss"], F.lit(0))["text"]))

    return rows.select(F.col("e.id").alias("entry_id"), F.get("e.kanji", F.lit(0))["text"].alias("written"), F.get("e.kana", F.lit(0))["text"].alias("pronounced"), F.size("e.kanji").alias("n_kanji"), F.size("e.sense").alias("n_senses"), F.transform("e.sense", glosses).alias("senses"))


def word_dict_ingest(spark: SparkSession, path: str) -> DataFrame:
    return word_dict_entries(spark.read.text(path))


def backup_read(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON backups (value), whole or of one content -> (known words, vocabulary); rows that don't parse are left out."""
    doc = F.from_json("value", f"knownWords array<string>, contentVocab map<string,{VOCAB}>, content struct<id:string>, vocab {VOCAB}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(doc.alias("d")).where("d._corrupt IS NULL")
    known = rows.select(F.explode("d.knownWords").alias("word")).where("word IS NOT NULL AND trim(word) <> ''").distinct()
    whole = rows.select(F.explode("d.contentVocab").alias("content_id", "v"))
    single = rows.where("d.content.id IS NOT NULL").select(F.col("d.content.id").alias("content_id"), F.col("d.vocab").alias("v"))
    return known, whole.unionByName(single).select("content_id", F.explode("v").alias("w")).select("content_id", "w.*")


def vocab_cache_valid(lines: DataFrame) -> DataFrame:
    """Snapshots (snapshot_id, content_id, pos, breakdown JSON) -> valid: every content's first word has both keys, null values included."""
    first = lines.groupBy("snapshot_id", "content_id").agg(F.min_by("breakdown", "pos").alias("b"))
    keys = F.coalesce(F.json_object_keys("b"), F.array().cast("array<string>"))
    fine = F.array_contains(keys, "jlptScore") & F.array_contains(keys, "highestGrade")
    return first.groupBy("snapshot_id").agg(F.bool_and(fine).alias("valid"))


def srs_ingest(assignments: DataFrame, subjects: DataFrame) -> DataFrame:
    """assignments (seq, subject_id, stage) and subjects (id, characters) -> ch, stage: the later assignment wins."""
    named = subjects.where("characters IS NOT NULL").select(F.col("id").alias("subject_id"), F.col("characters").alias("ch"))
    return assignments.join(named, "subject_id").groupBy("ch").agg(F.max_by("stage", "seq").alias("stage"))
