"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native: DataFrame functions only).

Every document gets the exponential key -ln(u) / weight, u a uniform number made from a digest of its id and text, so
reruns agree. A source whose target is m whole times its size and a rest takes m complete epochs; then its documents in
order of their keys up to the rest. The prefix sum runs in two levels: sizes by (source, key bucket) are summed before any
row is moved, and only the one bucket in which a source's rest ends is sorted, so a source with a third of all rows
never meets in one task. Sources themselves are ranked in one window: their table has a row for each, not for each document.

Defined results: null text has size 0; null sources are a source of their own, last in order; documents of size 0 are
taken 0 times; ties of keys fall by doc_id and then by digest, so equal rows take the same key and are still counted one by one;
an empty table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.shared import joined_small, words, written

#: Buckets of keys for each doubling; the rows of one of them, for each source, are sorted together. Whatever the weights, exponential
#: keys put no more than ln(2) / (e * BUCKETS), 0.025 %, of a source's rows into one bucket on average.
BUCKETS = 1024


def uniform(*parts: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 0.5) / F.lit(float(2**48))


def lexical_quality(found: Column) -> Column:
    """0.1 to 1: the share of distinct words, by which a document's chance of an early key grows."""
    return F.when(F.size(found) > 0, 0.1 + F.lit(0.9) * F.size(F.array_distinct(found)) / F.size(found)).otherwise(F.lit(0.1))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes (source, source_size), one row each -> with target: the total shared by weight, never above cap x source_size.

    The level at which the excess of full sources settles is found in one pass over the sources in order of
    cap * size / weight. The table has one row for each source, not for each document."""
    everything = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(everything) - 1) % len(weights) + 1).cast("bigint"))
    by_ratio = W.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    ranked = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") <= cap * F.col("source_size"))
    ranked = ranked.withColumn("_lambda", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    full = cap * F.col("source_size")
    target = F.least(full.cast("double"), F.coalesce(F.col("_lambda") * F.col("_w"), F.lit(0.0)))
    return ranked.select("source", "source_size", target.alias("target"))


def row_key() -> Column:
    """A 64-bit name of a row, which rows equal in doc_id, source and text share."""
    return F.xxhash64("doc_id", "source", "text")


def keyed(docs: DataFrame, seed: str, quality) -> DataFrame:
    """docs with size, _row, _key, _tie and _bucket."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumns({"_row": row_key(), "_words": words(F.col("text")), "_digest": digest})
    rows = rows.withColumns({"_size": F.size("_words").cast("bigint"), "_key": -F.log(uniform(F.col("doc_id"), F.col("_digest"), seed=seed)) / quality(F.col("_words")), "_tie": F.substring("_digest", 1, 8)})
    return rows.withColumn("_bucket", F.floor(F.log2("_key") * BUCKETS).cast("int")).drop("_words", "_digest")


def planned(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """keyed rows -> for each source its size, target, complete epochs and the bucket in which the rest of its target ends."""
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_sum"))
    sources = source_targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, cap)
    epochs = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).otherwise(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("bigint")
    sources = sources.withColumn("_epochs", epochs).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size")))
    sources = written(sources, "mix-sources")
    order = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0)))
    s = sources.select(F.col("source").alias("_s"), "_rest")
    ends = ends.join(s, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("_before") <= F.col("_rest"))
    ends = ends.groupBy("source").agg(F.max(F.struct("_bucket", "_before")).alias("_end"))  # the bucket in which the rest ends
    sources = sources.alias("a").join(ends.select(F.col("source").alias("_s"), "_end"), F.col("a.source").eqNullSafe(F.col("_s")), "left")
    sources = sources.select(F.col("a.source").alias("_s"), "source_size", "target", "_epochs", "_rest", F.col("_end._bucket").alias("_last"), F.col("_end._before").alias("_before"))
    return written(sources, "mix-plan")


def of_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """keyed rows with what is planned for their source and copies, right outside the bucket in which the rest ends."""
    copies = F.when(F.col("_size") > 0, F.col("_epochs") + (F.col("_bucket") < F.col("_last")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return joined_small(rows, sources, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies)


def at_end(rows: DataFrame) -> DataFrame:
    """of_sources rows of the buckets in which rests end, with their copies."""
    within = W.partitionBy("_s").orderBy("_key", "doc_id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    reached = F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0)) + F.col("_size") / 2
    extra = ((reached <= F.col("_rest")) & (F.col("_size") > 0)).cast("bigint")
    return rows.where("_bucket = _last").withColumn("copies", F.col("copies") + extra)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", quality=lexical_quality) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, row_key, size, source_size, target, taken (words) and copies (times taken).

    quality maps the column of a text's words to a positive weight."""
    rows = written(keyed(docs.select("doc_id", "source", "text"), seed, quality).drop("text"), "mix-rows")
    rows = of_sources(rows, planned(rows, weights, cap))
    rows = rows.where("_bucket <> _last").unionByName(at_end(rows))
    return rows.select("doc_id", "source", F.col("_row").alias("row_key"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", quality=lexical_quality) -> DataFrame:
    """The mix itself: each document of docs as often as it is taken, with all columns of docs.

    Texts stay where they are; only those of the buckets in which rests end are joined with what their ranks give, equal rows
    together."""
    columns = docs.columns
    whole = keyed(docs, seed, quality)
    rows = written(whole.select("doc_id", "source", "_row", "_size", "_key", "_tie", "_bucket"), "mix-rows")
    sources = planned(rows, weights, cap)
    ranked = at_end(of_sources(rows, sources)).groupBy(F.col("_row").alias("_r")).agg(F.sum("copies").alias("_copies"))
    ranked = written(ranked, "mix-ends")
    whole = of_sources(whole, sources)
    sure = whole.where("_bucket <> _last").withColumn("_copies", F.col("copies"))
    ends = joined_small(whole.where("_bucket = _last"), ranked, F.col("_row") == F.col("_r")).dropDuplicates(["_row"])
    taken = sure.select(*columns, "_copies").unionByName(ends.select(*columns, "_copies")).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)
