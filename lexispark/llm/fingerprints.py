"""Document fingerprints by consistent weighted sampling (native: DataFrame functions only).

A text is the multiset of its words; a word's weight is its count. For each of SAMPLES positions, gamma-distributed numbers
made from hashes of the word and the position decide which (word, quantised weight) is sampled, such that two texts sample
the same one with a probability equal to their generalised Jaccard similarity (sum of minima over sum of maxima).

The minimum over a text's words is kept as one integer: the sampled value in its high bits, the sample's name in its low 32.
A term holds 60 bits of the word's hash and a count of at most 15; a word that occurs more often has further terms for the rest,
filled in order, whose minima and maxima sum to those of the whole counts. Two of n distinct terms meet with probability
n*n / 2**61.

Defined results: null is the empty text; empty texts have a fingerprint of their own, alike only to one another; rows with equal
doc_id and text count as one document when the next is sought and each have a row; the document after the last is the
first, which for a single document is itself; nulls of doc_id come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.shared import partitions, word_hashes, written

SAMPLES = 64
MASK = (1 << 32) - 1


#: Bits of a packed term that hold its count; the others hold the word's hash.
COUNT_BITS = 4
TERM_COUNT = (1 << COUNT_BITS) - 1


def runs(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """keys and text columns -> keys and for each text the packed terms, one for each distinct word: runs in the sorted array of
    hashes. Each array is a column of its own, as lambdas evaluate expressions anew."""
    rows = rows.select(*keys, *[F.sort_array(word_hashes(F.col(c))).alias(f"_h{name}") for name, c in columns.items()])
    for name in columns:
        h = f"_h{name}"
        rows = rows.withColumn(f"_s{name}", F.filter(F.transform(h, at_start(h)), lambda i: i >= 0))
    for name in columns:
        terms = F.transform(f"_s{name}", pack(f"_h{name}", f"_s{name}"))
        more = F.flatten(F.transform(f"_s{name}", rest(f"_h{name}", f"_s{name}")))
        rows = rows.withColumn(name, F.when(F.size(f"_h{name}") > TERM_COUNT, F.concat(terms, more)).otherwise(terms))
    return rows.select(*keys, *columns)


def at_start(h: str):
    return lambda x, i: F.when((i == 0) | (x != F.get(F.col(h), i - 1)), i).otherwise(F.lit(-1))


def term(h: Column, n: Column) -> Column:
    return F.shiftleft(F.shiftright(h, COUNT_BITS), COUNT_BITS).bitwiseOR(n.cast("bigint"))


def run_length(h: str, s: str, start: Column, i: Column) -> Column:
    return F.coalesce(F.get(F.col(s), i + 1), F.size(h)) - start


def pack(h: str, s: str):
    return lambda start, i: term(F.get(F.col(h), start), F.least(run_length(h, s, start, i), F.lit(TERM_COUNT)))


def rest(h: str, s: str):
    """The terms of a run after its first, each of a name of its own."""

    def of(start: Column, i: Column) -> Column:
        n, name = run_length(h, s, start, i), F.get(F.col(h), start)
        further = F.transform(F.sequence(F.lit(1), F.floor((n - 1) / TERM_COUNT).cast("int")), lambda j: term(F.xxhash64(name, j), F.least(n - j * TERM_COUNT, F.lit(TERM_COUNT))))
        return F.when(n > TERM_COUNT, further).otherwise(F.array().cast("array<bigint>"))

    return of


def sample(k: int) -> Column:
    """The k-th sample's value and name for the word hash h of log weight lw."""
    first, second = F.xxhash64("h", F.lit(2 * k)), F.xxhash64("h", F.lit(2 * k + 1))
    bits = lambda x, shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask))
    low = (1 << 21) - 1
    u = lambda x, scale: (x.cast("double") + 0.5) / float(scale)
    r = -F.log(u(bits(first, 0, low), 1 << 21) * u(bits(first, 21, low), 1 << 21))
    beta = u(bits(first, 42, low), 1 << 21)
    c = -F.log(u(bits(second, 0, MASK), 1 << 32) * u(bits(second, 32, MASK), 1 << 32))
    t = F.floor(F.col("lw") / r + beta)
    value = F.log(c) - r * (t - beta + 1)
    name = second.bitwiseXOR(F.shiftleft(t, 16)).bitwiseAND(F.lit(MASK))
    return F.shiftleft(F.floor(value * float(1 << 20)), 32).bitwiseOR(name)


def sketches(terms: DataFrame, keys: list[str], texts: list[str], samples: int) -> DataFrame:
    """keys and one or two columns of packed terms -> keys and a sketch for each, array<bigint>, the names of the samples.

    A term that two texts share with equal counts is sampled once for both. Keys must name rows uniquely."""
    of = lambda array, which: F.transform(array, lambda p: F.struct(p.alias("p"), F.lit(which).alias("f")))
    if len(texts) == 1:
        parts = of(F.col(texts[0]), 1)
    else:
        a, b = texts
        parts = F.concat(of(F.array_intersect(a, b), 3), of(F.array_except(a, b), 1), of(F.array_except(b, a), 2))
    rows = terms.select(*keys, F.explode_outer(parts).alias("_t")).select(*keys, "_t.f", F.shiftright("_t.p", COUNT_BITS).alias("h"), F.log(F.col("_t.p").bitwiseAND(F.lit(TERM_COUNT)).cast("double")).alias("lw"))
    least = rows.groupBy(*keys, "f").agg(*[F.min(sample(k)).alias(f"m{k}") for k in range(samples)])
    both = least.groupBy(*keys).agg(*[F.min(F.when(F.col("f").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"m{k}"))).alias(f"{t}{k}") for i, t in enumerate(texts) for k in range(samples)])
    sketch = lambda t: F.array(*[F.coalesce(F.col(f"{t}{k}").bitwiseAND(F.lit(MASK)), F.lit(-1).cast("bigint")) for k in range(samples)])
    return both.select(*keys, *[sketch(t).alias(t) for t in texts])


def fingerprint_table(texts: DataFrame, keys: list[str], column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and a text column -> keys and sketch."""
    return sketches(runs(texts, keys, {"sketch": column}), keys, ["sketch"], samples)


def likeness(a: Column, b: Column) -> Column:
    """The share of positions at which two sketches have the same sample."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.size(a)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(MASK)))), 8, "0")), "")


def followers(docs: DataFrame) -> DataFrame:
    """docs (doc_id, rid, n_chars) -> doc_id, rid, n_chars, copies, next_rid: the row after each by (doc_id, rid), the first
    after the last. Equal rows are one, with their number.

    Rows are dealt by ranges; only the first row of each range is looked at across ranges."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("rid").asc()]
    rows = docs.groupBy("doc_id", "rid", "n_chars").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    heads = dealt.groupBy("_range").agg(F.min_by("rid", F.struct(F.col("doc_id").isNotNull(), "doc_id", "rid")).alias("_head"))
    by_range = W.orderBy("_range")
    first = F.first("_head").over(by_range.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select(F.col("_range").alias("_r"), F.coalesce(F.lead("_head").over(by_range), first).alias("_after"))
    following = F.lead("rid").over(W.partitionBy("_range").orderBy(*order))
    linked = dealt.withColumn("_next", following).join(heads, F.col("_range") == F.col("_r"))
    return written(linked.select("doc_id", "rid", "n_chars", "copies", F.coalesce("_next", "_after").alias("next_rid")), "followers")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """docs (doc_id, text) -> each text's fingerprint beside that of its edited text (its last quarter replaced by the start
    of the next document) and its likeness to the edited text's and to the next document's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.xxhash64("doc_id", text).alias("rid")
    after = followers(docs.select("doc_id", rid, F.length(text).cast("bigint").alias("n_chars")))
    # both joins take the same two columns by the same key, so texts are shuffled once and the exchange is used again
    rows = docs.select(rid, text.alias("text"))
    wanted = after.select(F.col("rid").alias("_for"), F.col("next_rid").alias("_rid"), F.floor(F.col("n_chars") / 4).cast("int").alias("_k"))
    heads = rows.join(wanted, F.col("rid") == F.col("_rid")).select("_for", F.expr("left(text, _k)").alias("_head")).groupBy("_for").agg(F.max("_head").alias("_head"))
    edited = rows.join(heads, F.col("rid") == F.col("_for"))
    changed = F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.col("_head"))
    edited = edited.select("rid", "text", changed.alias("_changed")).withColumn("edited_sha256", F.sha2(F.col("_changed"), 256))
    keys = ["rid", "edited_sha256"]
    pairs = sketches(runs(edited, keys, {"own": "text", "edited": "_changed"}), keys, ["own", "edited"], samples)
    pairs = written(pairs, "sketches")
    following = pairs.select(F.col("rid").alias("_rid"), F.col("own").alias("_next"))
    own = after.select(F.col("rid").alias("_at"), "doc_id", "n_chars", "copies", "next_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = pairs.join(own, F.col("rid") == F.col("_at")).join(following, F.col("next_rid") == F.col("_rid"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("_next")).alias("near_next"))
