"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

The distinct pre-tokens of a batch go to an in-memory DuckDB of the task. Its recursive query holds one row of tokens for
each word; in every step the positions of a word are unnested to rows that join the merge table, the leftmost pair of
minimum rank is contracted, and words without a pair leave the recursion. Decoding joins token positions to the vocabulary
and concatenates their bytes in order of position.

Long words (unspaced scripts, encoded data) have a query of their own that keeps only the last state of a word and contracts,
in one step, every pair whose rank is the least within as many positions to either side as the longest token has bytes. No
merge of a lower rank can reach such a pair, since what it would have to form with a neighbour is no token; so the result is
that of one contraction after another, in a number of steps that doesn't grow with the word. This takes a vocabulary that was
built by merging: while a token forms, ranks never fall. The vocabulary is tested for this when it is loaded; with one that lacks it,
long words are contracted one pair at a time, exactly and slowly.

The driver reads the file once and sends the merge table, whose size is the vocabulary's, to all tasks.

Defined results: null is the empty text, which has no tokens; special strings are ordinary text; texts of any length are encoded whole;
equal rows get equal results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
import tempfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.pretokens import pretokens

#: Words of one recursive query.
WORDS = 20_000
#: Documents of one Arrow batch that are handled together.
ROWS = 500
#: Words that a task remembers between batches, in two generations of this size (some 200 bytes a word); words not met for long are
#: encoded anew.
REMEMBERED = 200_000
SHIFT = 32

ENCODE = f"""
WITH RECURSIVE step(w, toks, done) AS (
    SELECT w, toks, len(toks) < 2 FROM words
    UNION ALL
    SELECT w, CASE WHEN best IS NULL THEN toks ELSE toks[:spot - 1] || [new] || toks[spot + 2:] END, best IS NULL OR len(toks) = 2
    FROM (
        SELECT w, any_value(toks) AS toks, min(found) AS best, min(found) & {(1 << SHIFT) - 1} AS spot, (min(found) >> {SHIFT})::INTEGER AS new
        FROM (
            SELECT p.w, p.toks, (m.new::BIGINT << {SHIFT}) | p.pos AS found
            FROM (SELECT w, toks, (unnest(toks[:-2])::BIGINT << 20) | unnest(toks[2:]) AS pair, generate_subscripts(toks[2:], 1) AS pos
                  FROM step WHERE NOT done) p
            LEFT JOIN merges m ON m.pair = p.pair)
        GROUP BY w)
)
SELECT w, toks FROM step WHERE done ORDER BY w
"""
#: Bytes beyond which a word is a long one, and bytes of long words in one query.
LONG, LONG_BYTES = 64, 200_000


def encode_long(span: int) -> str:
    return f"""
WITH RECURSIVE step(w, toks, done) USING KEY (w) AS (
    SELECT w, toks, len(toks) < 2 FROM words
    UNION ALL
    SELECT w, list(CASE WHEN fires THEN new ELSE tok END ORDER BY pos) FILTER (WHERE NOT taken), NOT bool_or(fires)
    FROM (
        SELECT w, pos, tok, new, fires, coalesce(lag(fires) OVER (PARTITION BY w ORDER BY pos), false) AS taken
        FROM (
            SELECT w, pos, tok, new, new IS NOT NULL AND (row_number() OVER run) % 2 = 1 AND bool_and(least) OVER run AS fires
            FROM (
                SELECT w, pos, tok, new, pos - row_number() OVER (PARTITION BY w, new ORDER BY pos) AS part,
                    new = min(new) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN {span} PRECEDING AND {span} FOLLOWING) AS least
                FROM (
                    SELECT p.w, p.pos, p.tok, m.new
                    FROM (SELECT w, unnest(toks) AS tok, unnest(list_append(toks[2:], -1)) AS following, generate_subscripts(toks, 1) AS pos
                          FROM step WHERE NOT done) p
                    LEFT JOIN merges m ON m.pair = (p.tok::BIGINT << 20) | p.following))
            WINDOW run AS (PARTITION BY w, new, part ORDER BY pos)))
    GROUP BY w
)
SELECT w, toks FROM step ORDER BY w
"""


DECODE = """
SELECT w, unhex(string_agg(v.hex, '' ORDER BY p.pos)) AS bytes
FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM coded) p JOIN vocabulary v ON v.tok = p.tok
GROUP BY w ORDER BY w
"""


#: One contraction a step, as in ENCODE, but keeping only the last state of a word.
ENCODE_ONE = ENCODE.replace("step(w, toks, done) AS", "step(w, toks, done) USING KEY (w) AS").replace(" WHERE done ORDER BY w", " ORDER BY w")


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their ids, all pairs of tokens that make one, and whether long words may be contracted in many places at once."""

    tokens: list[bytes]
    ids: list[int]
    pairs: np.ndarray
    made: np.ndarray
    grows: bool


def ranks_never_fall(ranks: dict[bytes, int]) -> bool:
    """Whether each merge on the way to a token has a rank no lower than the one before."""
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == math.inf:
                break
            if rank < last:
                return False
            last = rank
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs, made = array("q"), array("i")
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pairs.append((left << 20) | right)
                made.append(rank)
    return Vocabulary(list(ranks), list(ranks.values()), np.array(pairs, np.int64), np.array(made, np.int32), ranks_never_fall(ranks))


class Merger:
    """One DuckDB of a task with the merge table, and the words met before.

    A pair's rank is the id of the token that it makes, so ids serve as ranks. A word of one token needs no merge."""

    def __init__(self, vocabulary: Vocabulary, remembered: int, packed: bool = False, decode: bool = True):
        """packed: ids are kept as the bytes of 32-bit numbers, else as a text; decode: whether ids are decoded too."""
        import duckdb

        self.bound, self.packed, self.decode = remembered, packed, decode

        self.ranks = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[bytes, tuple[bytes, bytes | None, int]] = {}
        self.before: dict[bytes, tuple[bytes, bytes | None, int]] = {}
        self.long = encode_long(max(map(len, vocabulary.tokens))) if vocabulary.grows else ENCODE_ONE
        spill = os.path.join(tempfile.gettempdir(), f"duckdb-{os.getpid()}")  # made only when a word outgrows the memory limit, gone with the worker
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": spill})
        self.table("merges", pa.table({"pair": vocabulary.pairs, "new": vocabulary.made}))
        if decode:
            self.table("vocabulary", pa.table({"tok": pa.array(vocabulary.ids, pa.int32()), "hex": [t.hex() for t in vocabulary.tokens]}))

    def table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode(self, words: list[bytes]) -> tuple[pa.Array, list[bytes] | None]:
        """Token ids of each word, all long or none, as a list array, and the bytes that they decode to, if these are asked for."""
        offsets = np.cumsum([0, *map(len, words)], dtype=np.int32)
        start = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rows = pa.table({"w": np.arange(len(words), dtype=np.int32), "toks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(start))})
        self.table("words", rows)
        whole = [(i, self.ranks[w]) for i, w in enumerate(words) if w in self.ranks]  # such a word is a token, whatever merges would do
        if whole:
            at, tok = zip(*whole, strict=True)
            self.table("single", pa.table({"w": pa.array(at, pa.int32()), "t": pa.array(tok, pa.int32())}))
            self.db.execute("UPDATE words SET toks = [t] FROM single WHERE single.w = words.w")
        self.db.execute(f"CREATE OR REPLACE TABLE coded AS {self.long if len(words[0]) > LONG else ENCODE}")
        lists = self.db.sql("SELECT toks FROM coded ORDER BY w").to_arrow_table()["toks"].combine_chunks()
        return lists, self.db.sql(DECODE).to_arrow_table()["bytes"].to_pylist() if self.decode else None

    def look_up(self, words: list[bytes]) -> list[tuple[bytes, bytes | None, int]]:
        """(ids, packed or joined by spaces, decoded bytes if asked for, number of ids) of each distinct word."""
        out = [self.remembered(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        short = [i for i in missing if len(words[i]) <= LONG]
        parts = [short[a : a + WORDS] for a in range(0, len(short), WORDS)]
        total = LONG_BYTES
        for i in missing:
            if len(words[i]) > LONG:
                if total + len(words[i]) > LONG_BYTES:
                    parts.append([])
                    total = 0
                parts[-1].append(i)
                total += len(words[i])
        for part in parts:
            lists, decoded = self.encode([words[i] for i in part])
            if self.packed:
                flat, ends = lists.flatten().to_numpy().astype(np.int32).tobytes(), [0, *np.cumsum(4 * pc.list_value_length(lists).to_numpy()).tolist()]
                joined = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            else:
                joined = pc.binary_join(lists.cast(pa.list_(pa.string())), " ").cast(pa.binary()).to_pylist()
            sizes = pc.list_value_length(lists).to_pylist()
            for i, *row in zip(part, joined, decoded or [None] * len(part), sizes, strict=True):
                ids, text, n = row
                out[i] = self.remember(words[i], (ids, words[i] if text == words[i] else text, n))
        return out

    def remembered(self, word: bytes) -> tuple[bytes, bytes | None, int] | None:
        found = self.known.get(word)
        if found is None and (found := self.before.pop(word, None)) is not None:
            self.remember(word, found)
        return found

    def remember(self, word: bytes, row: tuple[bytes, bytes | None, int]) -> tuple[bytes, bytes | None, int]:
        if len(self.known) >= self.bound:
            self.before, self.known = self.known, {}
        self.known[word] = row
        return row


def encode_udf(vocabulary, with_ids: bool, remembered: int, decode: bool = True):
    """vocabulary: a Vocabulary that all executors have. Digests are always of ids and decoded texts; ids can go without these."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Merger(vocabulary.value, remembered, with_ids, decode)  # made for each task and gone with it: workers are used again by stages that need their memory
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                lists = batch.column("_p")
                coded = lists.flatten().dictionary_encode()
                found = own.look_up(coded.dictionary.cast(pa.binary()).to_pylist())
                ids, decoded, sizes = zip(*found, strict=True) if found else ((), (), ())
                ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int32)
                nested = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.binary()).take(coded.indices))  # noqa: E731, B023
                joined = lambda values, by: pc.binary_join(nested(values), by)  # noqa: E731, B023
                total = np.append(0, np.cumsum(np.array(sizes, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)))
                digest = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column])
                columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(total[ends[1:]] - total[ends[:-1]])}
                if with_ids:
                    of = np.append(0, np.cumsum(np.array(sizes, np.int64))).astype(np.int32)
                    per_word = pa.ListArray.from_arrays(pa.array(of), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), per_word.take(coded.indices).flatten())
                    if decode:
                        columns["decoded"] = joined(decoded, b"").cast(pa.string())
                else:
                    columns |= {"ids_sha256": digest(joined(ids, b" ")), "decoded_sha256": digest(joined(decoded, b""))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        own.db.close()
        own.known.clear()
        own.before.clear()
        pa.default_memory_pool().release_unused()

    return encode


def pieces(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.select("doc_id", pretokens(F.col("text"), pattern).alias("_p"))


def shared_vocabulary(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(load(path))


def encode_texts(docs: DataFrame, path: str, pattern: str, remembered: int = REMEMBERED, decode: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids and, unless decode is off, decoded: the token ids and the text decoded from them."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids array<int>" + ", decoded string" * decode
    return pieces(docs, pattern).mapInArrow(encode_udf(shared_vocabulary(docs, path), True, remembered, decode), schema)


def encode_digests(docs: DataFrame, path: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, digests of what encode_texts gives."""
    kind = dict(docs.dtypes)["doc_id"]
    return pieces(docs, pattern).mapInArrow(encode_udf(shared_vocabulary(docs, path), False, remembered), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
