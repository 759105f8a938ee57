"""Content tables: unions, overrides, duplicates, relations and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import text as T

# Which type stays of equal texts.
TYPE_PRIORITY = {"story": 1, "music": 2, "video": 3}


def content_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def content_override(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """Rows (content_id, ord, ...): the custom row wins for its id, at the place where the id was first seen."""
    rows = built_in.withColumn("_p", F.lit(0)).unionByName(custom.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    values = [c for c in rows.columns if c not in ("content_id", "ord", "_p")]
    per = rows.groupBy("content_id").agg(F.max_by(F.struct(*values), F.struct("_p", "ord")).alias("_v"), F.min(F.struct("_p", "ord")).alias("_o"))
    return per.select("content_id", F.col("_o.ord").alias("ord"), "_v.*")


def import_content(submitted: DataFrame) -> DataFrame:
    """Submitted forms (seq, title, text, url) -> content rows: trimmed, blank urls null, default description, id from seq."""
    trim = lambda c: F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")
    url = trim(F.coalesce("url", F.lit("")))
    return submitted.select(F.concat(F.lit("custom-"), F.col("seq").cast("string")).alias("content_id"), trim("title").alias("title"), trim("text").alias("text"), F.when(url != "", url).alias("media_url"), F.lit("Custom content").alias("description"))


def duplicate_groups(content: DataFrame) -> DataFrame:
    """Digests of texts that occur more than once: hash, copies, first_id and bytes of one copy. Absent texts are no duplicates."""
    return content.where("text IS NOT NULL").groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("content_id").alias("first_id"), F.max(F.octet_length("text")).alias("bytes")).where("copies > 1")


def duplicate_plan(content: DataFrame) -> DataFrame:
    """Each member of a duplicate group with keep or remove and the reason: stories before music before videos, then the lower id.

    A row is named by its type and id, since an id may occur once in each type; of rows equal in both the plan keeps one name. The kept
    row is an aggregate joined back, so a group that holds a third of all rows is never sorted in one task."""
    priority = F.lit(9)
    for name, p in TYPE_PRIORITY.items():
        priority = F.when(F.col("type") == name, p).otherwise(priority)
    rows = content.where("text IS NOT NULL").select("content_id", "type", F.md5("text").alias("hash"), F.octet_length("text").alias("bytes"), priority.alias("_p"))
    kept = rows.groupBy("hash").agg(F.min(F.struct("_p", "type", "content_id")).alias("_k"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    plan = rows.join(kept, "hash")
    keep = plan["content_id"].eqNullSafe(F.col("_k.content_id")) & plan["type"].eqNullSafe(F.col("_k.type"))
    others = F.concat(F.lit("first of "), F.col("copies").cast("string"), F.lit(" copies"))
    reason = F.when(keep, others).otherwise(F.concat(F.lit("same text as "), F.coalesce("_k.type", F.lit("?")), F.lit("/"), F.col("_k.content_id").cast("string")))
    return plan.select("content_id", "type", "hash", "bytes", "copies", F.when(keep, "keep").otherwise("remove").alias("action"), F.col("_k.content_id").alias("kept_id"), F.col("_k.type").alias("kept_type"), reason.alias("reason"))


def deduplicate(content: DataFrame) -> DataFrame:
    """content without the rows that the plan removes."""
    removed = duplicate_plan(content).where("action = 'remove'").select(F.col("content_id").alias("_id"), F.col("type").alias("_type")).distinct()
    return content.join(removed, F.col("content_id").eqNullSafe(F.col("_id")) & F.col("type").eqNullSafe(F.col("_type")), "left_anti")


def deduplicate_report(content: DataFrame) -> DataFrame:
    """What removal comes to, by type and in all (type null): kept, removed and freed_bytes, in one pass over the plan and the content."""
    removed = duplicate_plan(content).where("action = 'remove'").select("type", F.lit(0).alias("n"), F.lit(1).alias("gone"), F.col("bytes").cast("bigint").alias("bytes"))
    rows = content.select("type", F.lit(1).alias("n"), F.lit(0).alias("gone"), F.lit(0).cast("bigint").alias("bytes")).unionByName(removed)
    per = rows.rollup("type").agg(F.sum("n").alias("_n"), F.sum("gone").alias("removed"), F.sum("bytes").alias("freed_bytes"), F.grouping("type").alias("is_total"))
    return per.select("type", "is_total", (F.col("_n") - F.col("removed")).alias("kept"), "removed", "freed_bytes")


def type_counts(content: DataFrame) -> DataFrame:
    return content.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.length("text") == 0, 1)).alias("n_empty"))


def known_union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.select("word") for t in tables]).distinct()


def vocab_merge(existing: DataFrame, imported: DataFrame, fields: tuple[str, ...] = ("reading", "meaning", "score"), order: str | None = None) -> DataFrame:
    """Per content and word: imported fields win where they aren't null, other rows of both stay.

    Several imported rows of one word count as one: by order each field's last value that isn't null, without order its greatest value.
    The word comes first among the keys, so rows that are sorted before a shuffle have their equal values together."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)
    new = imported.groupBy("word", "content_id").agg(*[last(c).alias(f"_{c}") for c in fields])
    rows = existing.join(new, ["word", "content_id"], "full_outer")
    return rows.select("content_id", "word", *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def vocab_update_word(vocab: DataFrame, changes: DataFrame, fields: tuple[str, ...] = ("meaning", "score")) -> DataFrame:
    """changes (word, fields) take effect in every content that has the word; of several for a word, the greatest value of each field."""
    new = changes.groupBy("word").agg(*[F.max(c).alias(f"_{c}") for c in fields])
    rows = vocab.join(new, "word", "left")
    for c in fields:
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
    return rows.drop(*[f"_{c}" for c in fields])


def vocab_add_word(vocab: DataFrame, custom: DataFrame) -> DataFrame:
    """custom (content_id, word) go before the extracted words: score 0, a fixed meaning, ord below the least."""
    least = vocab.groupBy("content_id").agg(F.min("ord").alias("_m"))
    rows = custom.join(least, "content_id", "left").select("content_id", "word", F.lit("Custom Word").alias("meaning"), F.lit(0).alias("score"), (F.coalesce("_m", F.lit(0)) - 1).alias("ord"))
    return vocab.select("content_id", "word", "meaning", "score", "ord").unionByName(rows)


def related_stories(meta: DataFrame) -> DataFrame:
    """meta (content_id, parent_id, variant_type, episode, related array of ids) -> content_id, other_id, relation (variant, episode, series)."""
    child = meta.where("parent_id IS NOT NULL AND parent_id <> content_id")
    by_parent = child.select(F.col("parent_id").alias("content_id"), F.col("content_id").alias("other_id"), F.when(F.col("variant_type").isNotNull(), "variant").when(F.col("episode").isNotNull(), "episode").alias("relation"), "episode")
    explicit = meta.select("content_id", F.explode("related").alias("other_id"))
    kinds = meta.select(F.col("content_id").alias("other_id"), F.when(F.col("variant_type").isNotNull(), "variant").otherwise("series").alias("relation"))
    explicit = explicit.join(kinds, "other_id").select("content_id", "other_id", "relation", F.lit(None).cast("int").alias("episode"))
    parents = meta.select("content_id")
    return by_parent.where("relation IS NOT NULL").join(parents, "content_id", "left_semi").unionByName(explicit)


def parent_story(meta: DataFrame) -> DataFrame:
    parents = meta.select(F.col("content_id").alias("parent_id"), F.col("title").alias("parent_title"))
    return meta.join(parents, "parent_id", "left").select("content_id", "parent_id", "parent_title")


def children(meta: DataFrame) -> DataFrame:
    """Children of each parent in order: episodes by number (missing is 0), then variants by title."""
    child = meta.where("parent_id IS NOT NULL AND parent_id <> content_id")
    variant = F.col("variant_type").isNotNull()
    order = W.partitionBy("parent_id").orderBy(variant, F.when(variant, 0).otherwise(F.coalesce("episode", F.lit(0))), F.when(variant, F.col("title")), "content_id")
    return child.withColumn("n", F.row_number().over(order)).select("parent_id", "content_id", "n")


def series_stories(meta: DataFrame, series: DataFrame) -> DataFrame:
    """All content of the series in a table (series_id), which may be of any size."""
    return meta.join(series.select("series_id"), "series_id", "left_semi").select("series_id", "content_id", "title")


def comprehension_filter(status: DataFrame, which: str) -> DataFrame:
    if which == "almost":
        return status.where("total_count > 0 AND comprehension BETWEEN 90 AND 99")
    if which == "ready":
        return status.where("total_count > 0 AND comprehension = 100")
    return status


def validated(content: DataFrame, profile, limit: int = 50_000) -> DataFrame:
    return content.withColumn("error", T.validate_text(F.col("text"), profile, limit))
