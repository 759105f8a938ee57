"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie as one ragged numpy array of symbols. In each round every sequence looks up its
neighbouring pairs, finds its lowest rank and merges all its pairs of that rank at once; sequences without a pair leave
with their count of surviving symbols. The vocabulary is the public file whose path is a parameter.

Defined results: null texts have no bytes and no tokens; the special string inside a text is one token, as in the library; texts of
any length are counted whole; equal rows get equal results; an empty table gives an empty result; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.pretokens import pretokens

#: Distinct pre-tokens merged together.
CHUNK = 200_000
#: Documents of one Arrow batch that are handled together.
ROWS = 2_000
NONE = np.int64(1 << 40)


def byte_symbols() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself if printable, else the next above 255."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def merge_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the 256 bytes; sorted pair keys with their ranks and merged symbols."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
    merged = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    symbols = byte_symbols()
    return np.array([vocab[symbols[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int64), merged[order]


def surviving(data: np.ndarray, lengths: np.ndarray, path: str) -> np.ndarray:
    """data: the bytes of sequences one after another -> how many symbols remain of each after all merges."""
    of_byte, keys, ranks, merged = merge_table(path)
    counts = np.asarray(lengths, np.int64).copy()
    symbol, owner = of_byte[data], np.repeat(np.arange(len(counts)), counts)
    while len(symbol) > 1:
        pair = (symbol[:-1] << 32) | symbol[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[at] == pair) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(known, ranks[at], NONE), NONE)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbol)))
        low = np.repeat(lowest, sizes)
        chosen = (rank == low) & (low < NONE)
        place = np.arange(len(symbol))
        run_start = np.maximum.accumulate(np.where(chosen & ~np.append(False, chosen[:-1]), place, 0))
        chosen &= (place - run_start) % 2 == 0  # overlapping pairs merge from the left
        first = np.flatnonzero(chosen)
        symbol[first] = merged[at[first]]
        keep = low < NONE
        keep[first + 1] = False
        counts -= np.bincount(owner[first], minlength=len(counts))
        symbol, owner = symbol[keep], owner[keep]
    return counts


def piece_counts(pieces: pa.Array, path: str) -> np.ndarray:
    """Tokens of each distinct piece."""
    out = []
    for a in range(0, len(pieces), CHUNK):
        part = pa.concat_arrays([pieces.slice(a, CHUNK).cast(pa.large_binary())])
        offsets = np.frombuffer(part.buffers()[1], np.int64)[: len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        out.append(surviving(data, np.diff(offsets), path))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_udf(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                lists = batch.column("_p")
                coded = lists.flatten().dictionary_encode()
                per_piece = piece_counts(coded.dictionary, path)
                tokens = per_piece[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
                total = np.append(0, np.cumsum(tokens))
                ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
                n = total[ends[1:]] - total[ends[:-1]] + batch.column("_special").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, special: str = "<|endoftext|>", limit: int = 1024) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit. path: a byte-level BPE file in JSON; pattern: its pre-tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    quoted = "".join("\\" + c if not c.isalnum() else c for c in special)
    segments = F.split(text, quoted)
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), segments.alias("_s"))
    rows = rows.select("doc_id", "n_bytes", (F.size("_s") - 1).cast("bigint").alias("_special"), F.flatten(F.transform("_s", lambda s: pretokens(s, pattern))).alias("_p"))
    kind = dict(docs.dtypes)["doc_id"]
    counted = rows.mapInArrow(count_udf(path), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
