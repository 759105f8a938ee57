"""Counts and places of the tokens of each text, a batch of texts at a time.

Texts are cut into tokens, counted and searched where they are read, in Arrow batches, so neither tokens nor texts are shuffled and no
task holds more than a batch. Runs of one class of characters are cut in numpy from the bytes of a batch, by a table of the characters
that Spark's regular expression takes; of other profiles Spark cuts the texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.profiles import ScriptProfile

#: Tokens that are counted together.
TOKENS = 2_000_000
#: Bytes of text that are cut together.
BYTES = 12_000_000
#: A token that is a run of one class of characters.
ONE_CLASS = re.compile(r"(\\p\{\w+\}|\[[^\[\]&]+\])\+")
_tables: dict[str, bytes] = {}


def lowered(text: Column | str, profile: ScriptProfile) -> Column:
    return F.lower(text) if profile.lower else F.col(text) if isinstance(text, str) else text


def runs(text: Column, profile: ScriptProfile) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(profile.token), F.lit(0))


def parts(batch: pa.RecordBatch, ends: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    starts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def slices(batch: pa.RecordBatch, lists: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about TOKENS elements of its column lists."""
    yield from parts(batch, batch.column(lists).offsets.to_numpy()[1:].astype(np.int64), TOKENS)


def characters(spark: SparkSession, token: str) -> bytes:
    """A bit for each code point: whether the regular expression takes it."""
    if token not in _tables:
        ids = spark.range(0, 0x110000, 1, 8).where("id NOT BETWEEN 55296 AND 57343")
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        taken = np.zeros(0x110000, bool)
        taken[[r.id for r in ids.where(char.rlike(token)).collect()]] = True
        _tables[token] = np.packbits(taken).tobytes()
    return _tables[token]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(codes: np.ndarray, offsets: np.ndarray, taken: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of taken characters in texts (UTF-8) -> the runs, where those of each text begin, and first byte and end of each run."""
    one = np.zeros(256, bool)
    one[:128] = taken[:128]
    letter = np.append(one[codes], False)
    lead = np.flatnonzero(codes >= 0xC0)
    if len(lead):
        size = 2 + (codes[lead] >= 0xE0) + (codes[lead] >= 0xF0)
        point = codes[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            point = np.where(size > k, (point << 6) | (codes[np.minimum(lead + k, len(codes) - 1)] & 0x3F), point)
        yes = taken[np.minimum(point, 0x10FFFF)]
        for k in (0, 1, 2, 3):
            letter[lead[yes & (size > k)] + k] = True
    letter = letter[:-1]
    before, after = np.append(False, letter[:-1]), np.append(letter[1:], False)
    before[offsets[offsets < len(codes)]] = False
    after[offsets[offsets > 0] - 1] = False
    begin, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    ends = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(codes[letter]))
    return found, np.searchsorted(begin, offsets), begin, end


def cut_batches(batches: Iterator[pa.RecordBatch], taken: bytes):
    """content_id, text -> the rows of about BYTES bytes, their bytes and what cut finds in them."""
    table = np.unpackbits(np.frombuffer(taken, np.uint8)).astype(bool)
    for whole in batches:
        ends = text_bytes(whole.column("text"))[1][1:]
        for batch in parts(whole, ends, BYTES):
            codes, offsets = text_bytes(batch.column("text"))
            if len(codes):
                yield batch, codes, offsets, *cut(codes, offsets, table)


def run_lists(batches: Iterator[pa.RecordBatch], taken: bytes) -> Iterator[pa.RecordBatch]:
    """content_id, text -> content_id, runs."""
    for batch, _, _, found, starts, _, _ in cut_batches(batches, taken):
        yield pa.RecordBatch.from_arrays([batch.column("content_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), found)], names=["content_id", "runs"])


def on_runs(content: DataFrame, profile: ScriptProfile, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What count makes of each batch of texts (content_id, runs)."""
    text = F.coalesce(lowered("text", profile), F.lit(""))
    if ONE_CLASS.fullmatch(profile.token) is None:
        return content.select("content_id", runs(text, profile).alias("runs")).mapInArrow(count, schema)
    taken = characters(content.sparkSession, profile.token)
    return content.select("content_id", F.make_valid_utf8(text).alias("text")).mapInArrow(lambda batches: count(run_lists(batches, taken)), schema)


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements, and where each list begins among them."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content_id, runs -> a row for each text and distinct token: its number and first position."""
    for whole in batches:
        for batch in slices(whole, "runs"):
            tokens, starts = flat(batch.column("runs"))
            coded = tokens.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            key, first, n = np.unique(owner * max(1, len(coded.dictionary)) + codes, return_index=True, return_counts=True)
            owner = owner[first]
            ids = batch.column("content_id").take(pa.array(owner))
            surface = coded.dictionary.take(pa.array(codes[first]))
            yield pa.RecordBatch.from_arrays([ids, surface, pa.array(n.astype(np.int64)), pa.array((first - starts[owner]).astype(np.int32))], names=["content_id", "surface", "frequency", "ord"])


#: What run_groups can have of each text of a row, and what ungrouped makes of it.
LISTS = {"content_ids": "content_id", "frequencies": "frequency", "ords": "ord"}


def in_order(numbers: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2^32, by halves, which numpy sorts by radix."""
    low = np.argsort(numbers.astype(np.uint16), kind="stable")
    high = (numbers >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


def word_groups(batches: Iterator[pa.RecordBatch], asked: tuple[str, ...] = tuple(LISTS), first: bool = False) -> Iterator[pa.RecordBatch]:
    """content_id, runs -> a row for each distinct token of a part of the texts: the part, its number there, and of the texts that have it,
    ascending, or of the first of them alone, what is asked: ids, its number and first position in each."""
    part = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "runs"):
            tokens, starts = flat(batch.column("runs"))
            coded = tokens.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            ids = batch.column("content_id")
            rank = np.argsort(pc.array_sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64))[owner]
            at = in_order(rank)
            at = at[in_order(codes[at])]
            begin = np.flatnonzero(np.diff(codes[at] * batch.num_rows + rank[at], prepend=-1))
            n = np.diff(begin, append=len(at))
            places = np.searchsorted(codes[at[begin]], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
            if first:
                begin, n, places = begin[places[:-1]], n[places[:-1]], np.arange(len(places), dtype=np.int32)
            found = at[begin]
            total = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
            of = {"content_ids": lambda: ids.take(pa.array(owner[found])), "frequencies": lambda: pa.array(n.astype(np.int64)), "ords": lambda: pa.array((found - starts[owner[found]]).astype(np.int32))}  # noqa: B023
            lists = [pa.ListArray.from_arrays(pa.array(places), of[c]()) for c in asked]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), part)), coded.dictionary, pa.array(total), *lists], names=["part", "surface", "n", *asked])
            part += 1


def batch_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """runs -> a row for each distinct token of a batch with its number."""
    for whole in batches:
        for batch in slices(whole, "runs"):
            coded = flat(batch.column("runs"))[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n)], names=["surface", "n"])


def run_counts(content: DataFrame, profile: ScriptProfile) -> DataFrame:
    """content (content_id, text) -> content_id, surface, frequency, ord of its script runs. Texts are counted where they are read; only
    where ids repeat are the counts of their texts brought together."""
    found = on_runs(content, profile, text_counts, f"content_id {dict(content.dtypes)['content_id']}, surface string, frequency bigint, ord int")
    if not ids_repeat(content):
        return found
    return found.groupBy("content_id", "surface").agg(F.sum("frequency").alias("frequency"), F.min("ord").alias("ord"))


def ids_repeat(content: DataFrame) -> bool:
    return not content.groupBy("content_id").count().where("count > 1").isEmpty()


def run_groups(content: DataFrame, profile: ScriptProfile, asked: tuple[str, ...] = tuple(LISTS), first: bool = False) -> DataFrame:
    """run_counts by word: part, surface, n and those arrays of LISTS that are asked, content_ids among them. A part is a batch of whole
    texts, so words meet a row for each part in place of one for each text, and rows that are dealt by part have all words of a text
    together. With first the arrays have the first text of a part alone, which is enough for the first of all.

    Where ids repeat each count is a row of its own, and a text's rows are a part."""
    if not ids_repeat(content):
        kinds = dict(zip(LISTS, (dict(content.dtypes)["content_id"], "bigint", "int"), strict=True))
        return on_runs(content, profile, partial(word_groups, asked=asked, first=first), "part bigint, surface string, n bigint, " + ", ".join(f"{c} array<{kinds[c]}>" for c in asked))
    lists = [F.array(LISTS[c]).alias(c) for c in asked]
    return run_counts(content, profile).select(F.xxhash64("content_id").alias("part"), "surface", F.col("frequency").alias("n"), *lists)


def ungrouped(groups: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows of run_groups, or what they have become, as a row for each text: content_id, and frequency and ord if the groups have them.
    What isn't asked for isn't read; part and n stay if they are in kept."""
    own = [c for c in groups.columns if c not in ("part", "n", *LISTS) or c in kept]
    more = [c for c in LISTS if c in groups.columns and c != "content_ids"]
    rows = groups.select(*own, *more, F.posexplode("content_ids").alias("_at", "content_id"))
    return rows.select(*own, "content_id", *[F.get(c, F.col("_at")).alias(LISTS[c]) for c in more])


def first_places(groups: DataFrame) -> DataFrame:
    """ungrouped with the first text of each row alone."""
    return groups.withColumns({c: F.slice(c, 1, 1) for c in LISTS if c in groups.columns})


def run_totals(content: DataFrame, profile: ScriptProfile) -> DataFrame:
    """content (text) -> surface, n: how often each script run occurs in all texts."""
    rows = on_runs(content.select(F.lit(0).alias("content_id"), "text"), profile, batch_totals, "surface string, n bigint")
    return rows.groupBy("surface").agg(F.sum("n").alias("n"))


PLACE = "pos: int, surface: string, start_idx: int, end_idx: int, line_no: int"


def line_numbers(text: str, at: np.ndarray) -> np.ndarray:
    """The number of line breaks before each place of a text."""
    return np.searchsorted(np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10), at)


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content_id, text, tokens (pos, surface) -> content_id and the tokens that are found, with start, end and line."""
    for whole in batches:
        for batch in slices(whole, "tokens"):
            tokens, starts = flat(batch.column("tokens"))
            surfaces = tokens.field("surface")
            words, at, line = surfaces.to_pylist(), np.empty(len(tokens), np.int32), np.empty(len(tokens), np.int32)
            begin = starts.tolist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                a, b = begin[i], begin[i + 1]
                here, found = 0, []
                for word in words[a:b]:
                    x = text.find(word, here)
                    found.append(x)
                    if x >= 0:
                        here = x + len(word)
                at[a:b] = found
                line[a:b] = line_numbers(text, at[a:b])
            kept = np.flatnonzero(at >= 0)
            size = pc.utf8_length(surfaces).to_numpy(zero_copy_only=False).astype(np.int32)
            offsets = np.searchsorted(kept, starts)
            rows = pa.StructArray.from_arrays([tokens.field("pos").take(pa.array(kept)), surfaces.take(pa.array(kept)), pa.array(at[kept]), pa.array((at + size)[kept]), pa.array(line[kept])], names=["pos", "surface", "start_idx", "end_idx", "line_no"])
            yield pa.RecordBatch.from_arrays([batch.column("content_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], names=["content_id", "places"])


def token_places(rows: DataFrame) -> DataFrame:
    """rows (content_id, text, tokens: array of pos and surface in order) -> content_id, pos, surface, start_idx, end_idx of each token
    that is found searching forward from the end of the one before, and line_no of its start."""
    found = rows.mapInArrow(places, f"content_id {dict(rows.dtypes)['content_id']}, places array<struct<{PLACE}>>")
    return found.select("content_id", F.explode("places").alias("_p")).select("content_id", "_p.*")


def run_rows(batches: Iterator[pa.RecordBatch], taken: bytes) -> Iterator[pa.RecordBatch]:
    """content_id, text -> a row for each run: content_id, pos, surface, start_idx, end_idx, line_no."""
    for batch, codes, offsets, found, starts, begin, end in cut_batches(batches, taken):
        inner, breaks = np.flatnonzero((codes & 0xC0) == 0x80), np.flatnonzero(codes == 10)
        place = lambda at: at - np.searchsorted(inner, at)  # noqa: E731, B023
        owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        origin = place(offsets[:-1])[owner]
        line = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[:-1])[owner]
        numbers = (np.arange(len(begin)) - starts[owner], place(begin) - origin, place(end) - origin, line)
        pos, start, stop, line = (pa.array(c.astype(np.int32)) for c in numbers)
        yield pa.RecordBatch.from_arrays([batch.column("content_id").take(pa.array(owner)), pos, found, start, stop, line], names=["content_id", "pos", "surface", "start_idx", "end_idx", "line_no"])


def run_places(content: DataFrame, profile: ScriptProfile) -> DataFrame:
    """content (content_id, text) -> its script runs with their places and lines, in order of the text; content without an id goes.

    A run holds neither line breaks nor space, so it lies in the line of its start, which isn't blank."""
    text = lowered("text", profile)
    content = content.where("content_id IS NOT NULL AND text IS NOT NULL")
    if ONE_CLASS.fullmatch(profile.token) is not None:
        taken = characters(content.sparkSession, profile.token)
        rows = content.select("content_id", F.make_valid_utf8(text).alias("text"))
        return rows.mapInArrow(lambda batches: run_rows(batches, taken), f"content_id {dict(content.dtypes)['content_id']}, {PLACE.replace(':', '')}")
    tokens = F.transform(runs(text, profile), lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("surface")))
    return token_places(content.select("content_id", text.alias("text"), tokens.alias("tokens")))
