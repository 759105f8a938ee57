"""Writing content, decks, backups, reports and lookup snapshots."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.sources.files import small_files
from lexispark.sources.small_files import list_files, write_files
from lexispark.sources.staging import staged
from lexispark.sources.stored import exists, hadoop_path, local_folder


# The folder and the name of the body of each type.
FOLDERS = {"story": ("stories", "content.md"), "music": ("music", "transcript.md"), "video": ("videos", "transcript.md")}
#: Fields of the metadata that are always written, and those that are left out when empty.
ALWAYS, OPTIONAL = ("title", "type", "description"), ("level", "imageUrl", "mediaUrl", "author", "dateAdded")


def commit_folder(spark: SparkSession, staging: str, path: str) -> None:
    """staging becomes path in one rename, in place of what was there."""
    source, files = hadoop_path(spark, staging)
    target, _ = hadoop_path(spark, path)
    files.mkdirs(target.getParent())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"could not move {staging} to {path}")


def folder_sink(files: DataFrame, path: str, by: tuple[str, ...] = ("folder", "file")) -> None:
    """files (folder, file, value[, more]) -> one folder for each content with its files, as the reader of folders takes them.

    Tasks put their files into a folder beside path, which takes its name when all are done: readers see all of them or none."""
    spark = files.sparkSession
    staging = f"{path}.{uuid.uuid4().hex}"
    rows = files.repartition(F.col("folder")).sortWithinPartitions(*by)
    target, system = hadoop_path(spark, staging)
    if system.getScheme() == "file":  # Spark's writer takes some ten times as long for a small file
        write_files(rows, target.toUri().getPath(), by)
    else:
        rows.write.partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(staging)
    commit_folder(spark, staging, path)


def content_files(content: DataFrame) -> DataFrame:
    """content (id, type, text, ...) -> kind, folder, file, value: metadata and body of each; empty optional fields are left out."""
    of = lambda i: reduce(lambda c, t: c.when(F.col("type") == t, FOLDERS[t][i]), FOLDERS, F).otherwise(FOLDERS["video"][i])
    kept = [F.col("id").cast("string").alias("id"), *(F.col(c) for c in ALWAYS if c in content.columns), *(F.nullif(F.col(c), F.lit("")).alias(c) for c in OPTIONAL if c in content.columns)]
    if "tags" in content.columns:
        kept.append(F.when(F.size("tags") > 0, F.col("tags")).alias("tags"))
    both = F.array(F.struct(F.lit("metadata.json").alias("file"), F.to_json(F.struct(*kept)).alias("value")), F.struct(of(1).alias("file"), F.coalesce("text", F.lit("")).alias("value")))
    return content.select(of(0).alias("kind"), F.col("id").cast("string").alias("folder"), F.explode(both).alias("_f")).select("kind", "folder", "_f.*")


def content_sink(content: DataFrame, path: str) -> DataFrame:
    """Writes metadata and body of every content below a folder for its type, in one commit, and returns what is there by kind: contents
    (n) and empty bodies (n_empty), from the sizes of the files that were written."""
    folder_sink(content_files(content), path, ("kind", "folder", "file"))
    spark = content.sparkSession
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1).alias(name)
    if local := local_folder(spark, path):
        sizes = list_files(spark, local).select(F.col("at").cast("string").alias("path"), "length").select(part("kind"), part("file"), "length")
    else:
        there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "length")
        with small_files(spark):
            sizes = staged(there.select(part("kind"), part("file"), "length"), "sizes")
    return sizes.groupBy("kind").agg(F.count(F.when(F.col("file") == "metadata.json", 1)).alias("n"), F.count(F.when((F.col("file") != "metadata.json") & (F.col("length") <= 1), 1)).alias("n_empty"))


def new_stories(content: DataFrame, existing: DataFrame) -> DataFrame:
    """Stories whose slug isn't there yet; of several with one slug that of the smallest content_id."""
    rows = content.where("type = 'story'").withColumn("slug", T.slugify(F.col("title"))).join(existing.select("slug"), "slug", "left_anti")
    first = rows.groupBy("slug").agg(F.min("content_id").alias("_id")).withColumnRenamed("slug", "_slug")
    return rows.join(first, (F.col("slug") == F.col("_slug")) & (F.col("content_id") == F.col("_id"))).drop("_slug", "_id")


def content_sink_new_only(content: DataFrame, path: str) -> DataFrame:
    """Appends the stories whose slug the table at path doesn't have, and returns the table. A rerun appends nothing, one after a run
    that was cut short appends the rest."""
    spark = content.sparkSession
    there = spark.read.parquet(path) if exists(spark, path) else content.withColumn("slug", F.lit(None).cast("string")).limit(0)
    staged(new_stories(content, there), "new").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def ordered_export(lines: DataFrame, order: list[str], path: str, header: str | None = None, compression: str = "none") -> None:
    """lines (value and the columns of order) as one text in parts: the parts in order of their names, the header first.

    Ranges of the order are sorted in parallel; the folder takes its name in one rename when all parts are there."""
    spark = lines.sparkSession
    rows = lines.select(F.lit(1).alias("_part"), *order, "value")
    if header is not None:
        first = spark.createDataFrame([(0, header)], "_part int, value string")
        rows = rows.unionByName(first, allowMissingColumns=True)
    staging = f"{path}.{uuid.uuid4().hex}"
    rows.orderBy("_part", *order).select("value").write.option("compression", compression).text(staging)
    commit_folder(spark, staging, path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An ordered export -> n, value: its lines with their numbers, from 0.

    Lines are read one by one. A task names those of a block of a part in a row, so the first name and the number of each block give
    all numbers; names are written with the lines, as another read might deal the blocks otherwise."""
    place = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    lines = staged(spark.read.text(path).select(*place, "value"), "lines")
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block, not for each line
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    starts = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = lines.join(F.broadcast(starts), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return rows.select((F.col("_shift") + F.col("seq")).alias("n"), "value")


def deck_lines(vocab: DataFrame, known: DataFrame, levels: tuple[int, ...] = ()) -> DataFrame:
    """Flash-card lines: front, back and tags of each unknown word once, its first row."""
    rows = vocab.join(known.select("word"), "word", "left_anti")
    if levels:
        rows = rows.where(F.col("jlpt").isin(*levels))
    first = rows.groupBy("word").agg(F.min_by(F.struct("content_id", "ord", "reading", "meaning", "jlpt", "priorities"), F.struct("content_id", "ord")).alias("_f")).select("word", "_f.*")
    level = F.when(F.col("jlpt") > 0, F.concat(F.lit("JLPT_N"), F.col("jlpt").cast("string"))).otherwise("JLPT_native")
    tags = F.concat_ws(" ", level, F.transform(F.coalesce("priorities", F.array().cast("array<string>")), lambda p: F.concat(F.lit("freq_"), p)))
    return first.select("content_id", "ord", "word", F.concat_ws("\t", "word", F.concat(F.col("reading"), F.lit("<br>"), F.col("meaning")), tags).alias("line"))


def deck_export(vocab: DataFrame, known: DataFrame, path: str, levels: tuple[int, ...] = ()) -> None:
    """A deck file: its header, then the cards in the order in which their words were first seen."""
    lines = deck_lines(vocab, known, levels).select("content_id", "ord", "word", F.col("line").alias("value"))
    ordered_export(lines, ["content_id", "ord", "word"], path, "#separator:tab")


def backup_lines(vocab: DataFrame) -> DataFrame:
    """One JSON line for each content with its words in order: parts that a backup reader can take one by one.

    vocab may be dealt by a column part, of which each content has one: its rows are collected where they are."""
    by = [c for c in ("part", "content_id") if c in vocab.columns]
    rows = vocab.select(*by, "ord", "word", "reading", "meaning", "score")
    # dealt by content before they are collected, so that rows are shuffled as they are and not as lists made and sorted on both sides
    per = (rows if "part" in by else rows.repartition("content_id")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "word", "reading", "meaning", "score"))).alias("_w"))
    words = F.transform("_w", lambda w: F.struct(w["word"].alias("word"), w["reading"].alias("reading"), w["meaning"].alias("meaning"), w["score"].alias("score")))
    content = F.struct(F.col("content_id").cast("string").alias("id"))
    return per.select("content_id", F.to_json(F.struct(content.alias("content"), words.alias("vocab"))).alias("value"))


def known_lines(known: DataFrame, parts: int = 16) -> DataFrame:
    """Known words as JSON lines of bounded arrays."""
    per = known.groupBy(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("_p")).agg(F.sort_array(F.collect_list("word")).alias("knownWords"))
    return per.select(F.to_json(F.struct("knownWords")).alias("value"))


def story_lines(content: DataFrame, vocab: DataFrame, known: DataFrame) -> DataFrame:
    """Each content with its vocabulary, unknown words first, as one JSON line."""
    flagged = vocab.join(known.select(F.col("word").alias("_k")), F.col("word") == F.col("_k"), "left")
    return marked_lines(content, flagged.withColumn("known", F.col("_k").isNotNull()))


def marked_lines(content: DataFrame, marked: DataFrame) -> DataFrame:
    """story_lines from vocabulary whose known words are marked."""
    dealt = marked.select("content_id", "known", "ord", "word").repartition("content_id")
    per = dealt.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("known", "ord", "word"))).alias("_w"))
    words = F.transform("_w", lambda w: w["word"])
    rows = content.select("content_id", "title").join(per, "content_id", "left")
    return rows.select("content_id", F.to_json(F.struct("title", F.coalesce(words, F.array().cast("array<string>")).alias("vocab"))).alias("value"))


def story_export(content: DataFrame, vocab: DataFrame, known: DataFrame, path: str) -> None:
    """All contents with their vocabulary as JSON lines in order of their ids."""
    write_lines(story_lines(content, vocab, known), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of contents in order of their ids; written once before, as sorting looks at them twice."""
    ordered_export(staged(lines, "unordered"), ["content_id"], path, compression="gzip")


def report_lines(coverage: DataFrame) -> DataFrame:
    return coverage.where("is_total = 0").select(F.to_json(F.struct("content_id", "total", "with_definition", "accuracy")).alias("value"))

