"""Quality rules: repetition inside a document from a suffix array over its words.

Word hashes of many documents lie in one array; suffixes are ranked by prefix doubling, and only groups of suffixes that
still share a rank are sorted again. From neighbours in the suffix array come the longest common prefixes, hence for each
position the longest substring that starts there and occurs again. Positions whose repeat can't be extended to the left
start the maximal repeated substrings; the union of their spans is the covered part.

Defined results: null and empty texts have no words and fail the base rule; a text of any length is one row of work, never a prefix;
equal rows get equal results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import words

#: Words sorted together; a longer document is a chunk of its own.
CHUNK = 1_000_000


def suffix_repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring of the same document that starts there and starts elsewhere too.

    h: word hashes; doc: document numbers, ascending. The sorted (document, word) pairs give the first ranks; a rank is the
    place of its group's first suffix, so ranks stay comparable while groups split."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, side="right")  # where each position's document ends
    order = np.lexsort((h, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, k = [rank.copy()], 1
    while True:
        shared = np.bincount(rank, minlength=n)[rank] > 1
        at = np.flatnonzero(shared)
        if not len(at):
            break
        after = at + k
        following = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((following, rank[at]))
        a, f = rank[at][order], following[order]
        group = np.ones(len(a), bool)
        group[1:] = a[1:] != a[:-1]
        part = group.copy()
        part[1:] |= f[1:] != f[:-1]
        place = np.arange(len(a))
        start = np.maximum.accumulate(np.where(group, place, 0))
        own = np.maximum.accumulate(np.where(part, place, 0))
        rank[at[order]] = a + (own - start)
        k *= 2
        levels.append(rank.copy())
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    left, right = suffix[:-1], suffix[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[near], right[near]
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < end[left]) & (b < end[right])
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        common += np.where(same, 1 << level, 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of spans [start, start + length)."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    edge -= np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def chunk_features(h: np.ndarray, lengths: np.ndarray, least: int, window: int) -> dict[str, np.ndarray]:
    """Features of the documents whose words lie one after another in h."""
    n, docs = len(h), len(lengths)
    doc = np.repeat(np.arange(docs), lengths)
    longest = suffix_repeats(h, doc)
    previous = np.zeros(n, np.int64)
    if n:
        previous[1:] = np.where(doc[1:] == doc[:-1], longest[:-1], 0)
    maximal = np.flatnonzero((longest >= least) & (previous != longest + 1))
    windows = np.flatnonzero(longest >= window)
    count = lambda mask: np.bincount(doc[mask], minlength=docs).astype(np.int64)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc, longest)
    return {
        "n_repeat_words": count(covered(windows, np.full(len(windows), window), n)),
        "n_maximal_repeats": count(maximal),
        "n_covered_words": count(covered(maximal, longest[maximal], n)),
        "longest_repeat": most,
    }


def repetition_udf(least: int, window: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(batch.schema.get_field_index("_h"))
            offsets = array.offsets.to_numpy().astype(np.int64)
            values = array.values.to_numpy(zero_copy_only=False)
            parts, a = [], 0
            while a < len(array):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
                parts.append(chunk_features(values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]), least, window))
                a = b
            rest = [c for c in batch.schema.names if c != "_h"]
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in rest}
            for name in ("n_repeat_words", "n_maximal_repeats", "n_covered_words", "longest_repeat"):
                columns[name] = pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return features


def repetition(docs: DataFrame, least: int = 5, window: int = 8) -> DataFrame:
    """docs (doc_id, text) -> word counts, symbols, repeated lines and what the suffix array says of repeated words.

    least: the shortest repeat, in words, that counts as covered; window: the words of a repeated window."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda drop: F.length(text) - F.length(F.translate(text, drop, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", words(text).alias("_w"), (F.length(text) - without(" \t\n\x0b\f\r")).cast("bigint").alias("word_chars"), without("#*$%&|<>").cast("bigint").alias("n_symbols"), lines.alias("_lines"))
    rows = rows.select("doc_id", F.size("_w").cast("bigint").alias("n_words"), "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_maximal_repeats bigint, n_covered_words bigint, longest_repeat bigint"
    return rows.mapInArrow(repetition_udf(least, window), schema)


def quality_rules(docs: DataFrame, min_words: int = 20, max_window_percent: int = 30, max_covered_percent: int = 40, max_longest: int = 200) -> DataFrame:
    """repetition() with base_failed and kept: kept documents pass the base rule, have at most max_covered_percent of their
    words in repeated substrings, and no repeat longer than max_longest words."""
    rows = repetition(docs)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    fine = (100 * F.col("n_covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & fine)
