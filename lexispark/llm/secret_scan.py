"""Secret scans with a randomness test battery (native: DataFrame functions only).

Three base kinds are found by pattern: values assigned to a telling name, access keys, and hexadecimal runs. The method adds
random-looking strings: candidates are runs of at least LEAST token characters in the text in which assignments, then access
keys, then hexadecimal runs are blanked out. The smallest alphabet that holds a candidate is its inferred encoding, over which
four tests ask whether the characters are independent and uniform: chi-squared of symbol counts, chi-squared of digits,
capitals and others, runs above and below the alphabet's middle, serial correlation of neighbours. The least of the four
p-values m counts as 1 - (1 - m) ** 4, which is uniform for random strings if the tests are independent.

False discoveries are controlled among what is reported, by length, since short strings tell less: candidates fall into bands
of doubling length. A candidate is reported if its p-value exceeds its band's threshold t, so of random strings a share t is
missed. The share of p-values above 0.2, divided by 0.8, estimates how many of a band's candidates are random (4 % too many, as the
tests depend on one another a little), hence which share of those above t isn't. The threshold is the least of THRESHOLDS at which that share is at most FALSE_SHARE, and their largest
where none is: the thresholds' range bounds what may be missed, whatever else the corpus holds.

Defined results: null is the empty text, which has no spans; offsets are code points, ends exclusive; texts of any length and any
number of matches are scanned whole; equal rows get equal results; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: What a span is called, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in order of size; a candidate's encoding is the first that holds it.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)
#: Thresholds from which each band's is taken: bounds of the share of random strings that may be missed.
THRESHOLDS = tuple(round(0.006 + 0.002 * i, 3) for i in range(11))
#: The share of reported candidates that may be no random strings, by estimate.
FALSE_SHARE = 0.1
#: Beyond this p-value hardly any but random strings are expected.
CLEARLY_RANDOM = 0.2
#: The last band of lengths; band b begins at LEAST * 2 ** b.
LAST_BAND = 6


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, which a column used inside a lambda isn't."""
    return F.get(F.transform(F.array(value), body), 0)


def block_size(array: Column) -> Column:
    """The square root of an array's size: work over blocks of so many is n * sqrt(n) where going over all each time is n * n."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array))).cast("int"))


def over_blocks(array: Column, body) -> Column:
    """An array of body(block, number, size of blocks) for each block of a non-empty array."""

    def each(size: Column) -> Column:
        last = F.floor((F.size(array) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: body(F.slice(array, b * size + 1, size), b, size))

    return let(block_size(array), each)


def placed(pieces: Column) -> Column:
    """pieces (g, m, v: lengths of the gap before a match and of the match, its value) -> (start, end, value) of each."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["g"] + x["m"])

    def block(sums: Column):
        def of(part: Column, b: Column, size: Column) -> Column:
            first = F.struct(F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda acc, x: acc + x).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

            def step(acc: Column, x: Column) -> Column:
                begin = acc["at"] + x["g"]
                return F.struct((begin + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + x["m"]).alias("end"), x["v"].alias("value")))).alias("out"))

            return F.aggregate(part, first, step, lambda acc: acc["out"])

        return of

    return let(pieces, lambda p: let(over_blocks(p, lambda part, b, size: total(part)), lambda sums: F.flatten(over_blocks(p, block(sums)))))


def found(rows: DataFrame, pattern: str, name: str, group: int | None = None, text: str = "_text") -> DataFrame:
    """Adds the array column name of all matches (start, end, value): value is the match, or its group.

    Texts between matches (split) and the matches themselves alternate, so starts are running sums of their lengths."""
    others = [c for c in rows.columns]
    hit = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    rows = rows.withColumn("_gaps", F.when(hit, F.split(text, pattern, -1)).otherwise(none))
    rows = rows.withColumn("_all", F.when(F.size("_gaps") > 1, matches(0)).otherwise(none))
    rows = rows.withColumn("_value", F.col("_all") if group is None else F.when(F.size("_gaps") > 1, matches(group)).otherwise(none))
    pieces = F.transform(F.arrays_zip("_gaps", "_all", "_value"), lambda x: F.struct(F.length(x["_gaps"]).alias("g"), F.length(x["_all"]).alias("m"), x["_value"].alias("v")))
    spans = F.when(F.size("_all") > 0, placed(F.slice(pieces, F.lit(1), F.size("_all")))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return rows.withColumn(name, spans).select(*others, name)


def blanked(rows: DataFrame, pattern: str, least: int, group: int = 0) -> DataFrame:
    """Blanks in _left the matches of which the group has at least so many characters; no length changes."""
    hit = F.col("_left").rlike(pattern)
    values = F.regexp_extract_all("_left", F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split("_left", pattern, -1).alias("g"), F.regexp_extract_all("_left", F.lit(pattern), F.lit(0)).alias("m"), values.alias("v"))
    blank = lambda x: F.when(F.length(x["v"]) >= least, F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"])
    rebuilt = F.array_join(F.transform(pieces, lambda x: F.concat(x["g"], F.coalesce(blank(x), F.lit("")))), "")
    return rows.withColumn("_left", F.when(hit, rebuilt).otherwise(F.col("_left")))


def upper_normal(z: Column) -> Column:
    """1 - Phi(z), by the logistic approximation (absolute error under 0.0002)."""
    bounded = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * bounded + 0.070566 * bounded * bounded * bounded))


def chi_tail(chi: Column, df: Column) -> Column:
    """The upper tail of chi-squared, by Wilson and Hilferty."""
    return upper_normal((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def class_test(n: Column, k: Column) -> Column:
    """The p-value of the counts of digits, capitals and others among a value's n characters, by their shares of its alphabet."""

    def counts(c: str) -> list[Column]:
        digits, capitals = [F.length(c) - F.length(F.translate(c, x, "")) for x in (ALPHABETS[0][:10], ALPHABETS[4][10:])]
        return [digits, capitals, F.length(c) - digits - capitals]

    chi, df = F.lit(0.0), F.lit(-1)
    for seen, size in zip(counts("value"), counts("_a"), strict=True):
        chi = chi + F.when(size > 0, F.pow(seen - n * size / k, F.lit(2.0)) / (n * size / k)).otherwise(F.lit(0.0))
        df = df + (size > 0).cast("int")
    return chi_tail(chi, df)


def battery(rows: DataFrame) -> DataFrame:
    """rows with the string column value -> with encoding (place in ALPHABETS), n and p."""
    alphabet = F.lit(None).cast("string")
    for a in reversed(ALPHABETS):
        alphabet = F.when(F.length(F.translate("value", a, "")) == 0, F.lit(a)).otherwise(alphabet)
    rows = rows.withColumn("_a", alphabet).withColumn("n", F.length("value")).withColumn("_k", F.length("_a"))
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    rows = rows.withColumn("_x", F.transform(chars, lambda c: F.instr(F.col("_a"), c) - 1))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    n, k = F.col("n"), F.col("_k")
    squares = total(F.transform(F.array_distinct("_x"), lambda d: F.pow(F.size(F.filter("_x", lambda v: v == d)).cast("double"), F.lit(2.0))))
    rows = rows.withColumn("_chi", k / n * squares - n).withColumn("_mean", total(F.transform("_x", lambda v: v.cast("double"))) / n)
    rows = rows.withColumn("_high", F.size(F.filter("_x", lambda v: 2 * v >= k)).cast("double"))
    changes = F.size(F.filter(F.transform("_x", lambda v, i: (i > 0) & ((2 * v >= k) != (2 * F.get(F.col("_x"), i - 1) >= k))), lambda c: c))
    rows = rows.withColumn("_runs", changes + 1)
    deviation = F.col("_mean")
    rows = rows.withColumn("_var", total(F.transform("_x", lambda v: (v - deviation) * (v - deviation))))
    rows = rows.withColumn("_cov", total(F.transform("_x", lambda v, i: F.when(i > 0, (v - deviation) * (F.get(F.col("_x"), i - 1) - deviation)).otherwise(F.lit(0.0)))))
    df = k - 1
    chi = chi_tail(F.col("_chi"), df)
    low = n - F.col("_high")
    expected = 1 + 2 * F.col("_high") * low / n
    spread = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
    runs = F.when((F.col("_high") == 0) | (low == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * upper_normal(F.abs(F.col("_runs") - expected) / F.sqrt(spread)))
    serial = F.when(F.col("_var") > 0, 2 * upper_normal(F.abs(F.col("_cov") / F.col("_var") + 1 / (n - 1)) * F.sqrt(n - 1.0))).otherwise(F.lit(0.0))
    least = F.least(chi, class_test(n, k), runs, serial, F.lit(1.0))
    return rows.withColumn("p", 1 - F.pow(1 - F.greatest(least, F.lit(0.0)), F.lit(4.0)))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, _text, base and maybe: base spans as (start, kind, end), and the candidates."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = found(rows, ASSIGN, "_assign", 2)
    rows = found(rows, ACCESS, "_access")
    rows = found(rows, HEX, "_hex")
    rows = rows.withColumn("_left", F.col("_text"))
    for pattern, least, group in ((ASSIGN, 8, 2), (ACCESS, 16, 0), (HEX, 32, 0)):
        rows = blanked(rows, pattern, least, group)
    rows = found(rows, CANDIDATE, "maybe", text="_left")

    def of_kind(column: str, least: int, kind: int) -> Column:
        long_enough = F.filter(column, lambda s: F.length(s["value"]) >= least)
        return F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    spans = F.concat(of_kind("_assign", 8, 0), of_kind("_access", 16, 1), of_kind("_hex", 32, 2))
    return rows.withColumn("base", F.array_sort(spans)).drop("_assign", "_access", "_hex", "_left")


def tested(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each candidate with its band of length and p-value."""
    band = F.least(F.lit(LAST_BAND), F.floor(F.log2(F.col("n") / LEAST))).cast("int")
    return battery(rows.select(*keys, F.explode("maybe").alias("_s")).select(*keys, "_s.*")).select(*keys, "start", "end", band.alias("band"), "p")


def band_thresholds(each: DataFrame) -> DataFrame:
    """band, p of candidates -> band, threshold: a row for each of the few bands."""
    above = lambda t: F.sum((F.col("p") > t).cast("double"))
    counts = each.groupBy("band").agg(above(CLEARLY_RANDOM).alias("_clear"), *[above(t).alias(f"_r{i}") for i, t in enumerate(THRESHOLDS)])
    threshold = F.lit(THRESHOLDS[-1])
    for i, t in reversed(list(enumerate(THRESHOLDS))):
        false_share = 1 - F.col("_clear") / (1 - CLEARLY_RANDOM) * (1 - t) / F.greatest(F.col(f"_r{i}"), F.lit(1.0))
        threshold = F.when(false_share <= FALSE_SHARE, F.lit(t)).otherwise(threshold)
    return counts.select("band", threshold.alias("threshold"))


def row_name() -> Column:
    """A 64-bit name of a row, which rows equal in doc_id and text share."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_name and base, spans: arrays of (start, kind, end), kind a place in KINDS, in order.

    Texts are read once; what is written and joined are spans and candidates. Candidates go through the battery once for
    equal rows."""
    rows = base_spans(docs.select("doc_id", "text", row_name().alias("row_name")))
    rows = written(rows.select("doc_id", "row_name", "base", "maybe"), "candidates")
    each = written(tested(rows.where(F.size("maybe") > 0), ["row_name"]).dropDuplicates(["row_name", "start"]), "battery")
    limits = written(band_thresholds(each), "thresholds").withColumnRenamed("band", "_band")
    random = each.join(F.broadcast(limits), F.col("band") == F.col("_band")).where("p > threshold").groupBy(F.col("row_name").alias("_r")).agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("_random"))
    rows = rows.join(random, F.col("row_name") == F.col("_r"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("_random", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select("doc_id", "row_name", "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = scan(docs)
    count = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *[count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), count("spans", 3).alias("n_random"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span, overlapping ones as one, replaced by mark."""
    columns = docs.columns
    spans = scan(docs).where(F.size("spans") > 0).groupBy(F.col("row_name").alias("_r")).agg(F.first("spans").alias("_spans"))
    spans = written(spans, "spans")
    rows = docs.withColumn("_row", row_name()).join(spans, F.col("_row") == F.col("_r"), "left")
    rows = rows.withColumn("_t", F.coalesce("text", F.lit("")))

    def block(spans: Column):
        def of(part: Column, b: Column, size: Column) -> Column:
            """The text from the block's first span to the next block's, its own spans replaced."""
            begin = F.when(b > 0, F.get(part, F.lit(0))["start"]).otherwise(F.lit(0))
            end = F.coalesce(F.get(spans, (b + 1) * size)["start"], F.length("_t"))
            at = F.greatest(begin, F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), b * size), lambda s: s["end"])), F.lit(0)))
            return let(F.struct(F.substring(F.col("_t"), begin + 1, end - begin).alias("t"), begin.alias("begin"), at.alias("at")), lambda x: replaced(part, x))

        return of

    def replaced(part: Column, x: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            piece = F.substring(x["t"], acc["at"] - x["begin"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
            out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        rest = lambda acc: F.concat(acc["out"], F.substring(x["t"], acc["at"] - x["begin"] + 1, F.length(x["t"])))
        return F.aggregate(part, F.struct(x["at"].alias("at"), F.lit("").alias("out")), step, rest)

    cleaned = F.array_join(over_blocks(F.col("_spans"), block(F.col("_spans"))), "")
    rows = rows.withColumn("text", F.when(F.col("_spans").isNotNull(), cleaned).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*columns)
