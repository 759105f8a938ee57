"""BPE encoding and decoding by contiguous rank arrays.

A short word is a row of parts: where each part begins and ends (its boundaries), its id, and the rank of merging it with the next
part, all contiguous. In every step a row is scanned for its least rank (the leftmost of equal ones), the boundary between the two
parts is deleted, what lies behind it moves up by one place, and the ranks on both sides of the new part are looked up again; rows
without a rank left are done. The rows of a width class lie in one numpy array, so a step serves thousands of words. Scanning costs
the square of a word's length, so words beyond SHORT bytes keep their neighbours as links and their ranks in a heap; the result is
the same, since both take the leftmost least rank each time.

The distinct pieces of a batch are encoded once. Decoding takes the bytes of each id from the vocabulary and joins them.

Defined results: null is the empty text, which has no ids; the special string inside a text is its one id, as the library has it by
default, and decodes to itself; bytes that are no UTF-8 (an id sequence cut inside a character) decode to U+FFFD; texts of any length
are encoded whole; equal rows get equal results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.pretokens import pretokens
from lexispark.llm.token_counts import byte_symbols, merge_table

#: Bytes up to which a word is short, and the widths of the arrays that hold short words.
SHORT = 64
WIDTHS = (4, 8, 12, 16, 24, 32, 48, SHORT)
#: Rows of one array; documents of one Arrow batch that are handled together, fewer where they have more pieces than these.
WORDS, ROWS, PIECES = 16_384, 2_000, 5_000_000
NONE = np.int64(1 << 40)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[pa.Array, dict[str, int]]:
    """The bytes of each id (empty for ids that the file leaves out), and the ids of special strings."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of = {c: b for b, c in byte_symbols().items()}
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = {i: bytes(byte_of[c] for c in t) for t, i in file["model"]["vocab"].items()} | {i: t.encode() for t, i in added.items()}
    return pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.binary()), added


def ranks_of(left: np.ndarray, right: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair of ids (NONE where it doesn't merge) and its place in the merge table."""
    _, keys, ranks, _ = merge_table(path)
    pair = (left << 32) | right
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    return np.where(keys[at] == pair, ranks[at], NONE), at


def encode_rows(part: np.ndarray, size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """part: ids of single bytes, a row for each word, filled with -1; size: bytes of each word -> ids by row, and how many remain."""
    merged = merge_table(path)[3]
    n, width = part.shape
    out, left = np.full((n, width), -1, np.int64), size.copy()
    row = np.arange(n)
    inside = np.arange(width - 1) + 1 < size[:, None]
    rank = np.full((n, width), NONE)
    place = np.zeros((n, width), np.int64)
    found, at = ranks_of(part[:, :-1][inside], part[:, 1:][inside], path)
    rank[:, :-1][inside], place[:, :-1][inside] = found, at
    while len(row):
        best = rank.argmin(axis=1)
        here = np.arange(len(row))
        live = rank[here, best] < NONE
        if not live.all():
            ended = ~live
            out[row[ended], : part.shape[1]] = part[ended]
            row, part, rank, place, best = row[live], part[live], rank[live], place[live], best[live]
            here = np.arange(len(row))
            if not len(row):
                break
        left[row] -= 1
        part[here, best] = merged[place[here, best]]
        # the boundary behind the part at best goes: the next part and the rank that stood at it leave their arrays
        columns = np.arange(part.shape[1] - 1)
        parts_from = columns + (columns > best[:, None])
        ranks_from = columns + (columns >= best[:, None])
        part = np.take_along_axis(part, parts_from, axis=1)
        rank, place = np.take_along_axis(rank, ranks_from, axis=1), np.take_along_axis(place, ranks_from, axis=1)
        for at_column in (best - 1, best):
            two = (at_column >= 0) & (at_column + 1 < left[row])
            r, c = here[two], at_column[two]
            rank[r, c], place[r, c] = ranks_of(part[r, c], part[r, c + 1], path)
            gone = (at_column >= 0) & ~two & (at_column < rank.shape[1])
            rank[here[gone], at_column[gone]] = NONE
    return out, left


def encode_long(ids: list[int], path: str) -> list[int]:
    """One long word: its parts are linked, its ranks lie in a heap with the pair that they were found for."""
    _, keys, ranks, merged = merge_table(path)
    after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
    pair = lambda i, j: (ids[i] << 32) | ids[j]
    first, at = ranks_of(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64), path)
    heap = [(int(first[i]), int(i), int(i) + 1, int(at[i]), pair(i, i + 1)) for i in np.flatnonzero(first < NONE)]
    heapq.heapify(heap)
    while heap:
        _, i, j, place, key = heapq.heappop(heap)
        if ids[i] < 0 or after[i] != j or pair(i, j) != key:
            continue  # one of the two has merged since
        ids[i], ids[j] = int(merged[place]), -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0:
                place = int(np.searchsorted(keys, pair(x, y)))
                if place < len(keys) and keys[place] == pair(x, y):
                    heapq.heappush(heap, (int(ranks[place]), x, y, place, pair(x, y)))
    return [t for t in ids if t >= 0]


def encode_pieces(pieces: pa.Array, path: str) -> pa.ListArray:
    """Ids of each distinct piece (strings); a piece that is a special string has its own id."""
    of_byte, special = merge_table(path)[0], vocabulary(path)[1]
    if not len(pieces):
        return pa.array([], pa.list_(pa.int32()))
    flat = pa.concat_arrays([pieces.cast(pa.large_binary())])
    start = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
    data = of_byte[np.frombuffer(flat.buffers()[2] or b"", np.uint8)]
    size = np.diff(start)
    whole = pc.is_in(pieces, pa.array(list(special), pieces.type)).to_numpy(zero_copy_only=False)
    owners, ids = [], []
    for i in np.flatnonzero(whole | (size > SHORT)).tolist():
        tokens = [special[pieces[i].as_py()]] if whole[i] else encode_long(data[start[i] : start[i + 1]].tolist(), path)
        owners.append(np.full(len(tokens), i))
        ids.append(np.array(tokens, np.int64))
    for lower, width in zip((0, *WIDTHS), WIDTHS):
        chosen = np.flatnonzero((size > lower) & (size <= width) & ~whole)
        for a in range(0, len(chosen), WORDS):
            some = chosen[a : a + WORDS]
            columns = np.arange(width)
            inside = columns < size[some][:, None]
            part = np.full(inside.shape, -1, np.int64)
            part[inside] = data[(start[some][:, None] + columns)[inside]]
            out, left = encode_rows(part, size[some], path)
            owners.append(np.repeat(some, left))
            ids.append(out[columns < left[:, None]])
    owner, token = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(pieces))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token[order], pa.int32()))


def decode_ids(ids: pa.ListArray, path: str) -> pa.Array:
    """The bytes that each list of ids stands for."""
    tokens = vocabulary(path)[0].take(ids.flatten())
    offsets = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), b"")


def text_of(data: bytes) -> bytes:
    """UTF-8 of the text that bytes decode to."""
    return data.decode("utf-8", "replace").encode()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ROWS documents and about PIECES pieces."""
    total = np.cumsum(pc.list_value_length(batch.column("_p")).to_numpy(zero_copy_only=False))
    part = np.arange(batch.num_rows) // ROWS + (total // PIECES) * batch.num_rows
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def encode_udf(path: str, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                lists = batch.column("_p")
                coded = lists.flatten().dictionary_encode()
                ids = encode_pieces(coded.dictionary, path)
                sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                at = coded.indices.to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int32)
                total = np.append(0, np.cumsum(sizes[at]))[ends]
                of_docs = lambda per_piece: pa.ListArray.from_arrays(pa.array(ends), per_piece.take(coded.indices))  # noqa: E731, B023
                decoded = [text_of(x.as_buffer().to_pybytes()) for x in pc.binary_join(of_docs(decode_ids(ids, path)), b"")]
                columns = [batch.column("doc_id"), pa.array(np.diff(total))]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(total, pa.int32()), ids.take(coded.indices).flatten()), pa.array(decoded, pa.binary()).cast(pa.string())]
                else:
                    joined = pc.binary_join(of_docs(pc.binary_join(ids.cast(pa.list_(pa.string())), ",")), ",")
                    columns += [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *(["ids", "decoded"] if with_ids else ["ids_sha256", "decoded_sha256"])])

    return encode


def pieces_of(text: Column, pattern: str, special: str) -> Column:
    """Pieces of a text in order: special strings, and matches of the pattern in what lies between them."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in special)
    segments = F.split(F.coalesce(text, F.lit("")), quoted)
    after = lambda s, i: F.when(i > 0, F.concat(F.array(F.lit(special)), pretokens(s, pattern))).otherwise(pretokens(s, pattern))
    return F.flatten(F.transform(segments, after))


def encoded(docs: DataFrame, path: str, pattern: str, special: str, with_ids: bool, columns: str) -> DataFrame:
    rows = docs.select("doc_id", pieces_of(F.col("text"), pattern, special).alias("_p"))
    return rows.mapInArrow(encode_udf(path, with_ids), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, {columns}")


def encode_texts(docs: DataFrame, path: str, pattern: str, special: str = "<|endoftext|>") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids, decoded: the ids of each text and the text decoded from them."""
    return encoded(docs, path, pattern, special, True, "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, pattern: str, special: str = "<|endoftext|>") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, digests of what encode_texts gives."""
    return encoded(docs, path, pattern, special, False, "ids_sha256 string, decoded_sha256 string")
