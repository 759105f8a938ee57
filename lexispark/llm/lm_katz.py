"""Katz back-off language model over words: Good-Turing discounted bigram and unigram counts, exactly normalised back-off
weights, and the log10 probability of every text.

Counts are exchanged in bulk. Documents form blocks; a block sends its distinct n-grams, sorted and packed, to the shuffle
partition that their hash names, once each however often they occur, so a word or pair that fills a third of all rows is one
entry for a block. Partitions sum the counts into the count table (written, dealt by hash) and answer every block with totals
and with which block owns an n-gram; owners add up what their n-grams take from each context's mass, and from these sums come
the weights alpha(context) = (1 - discounted mass seen) / (1 - lower-order mass seen). A text's probability then recurs per
token: the discounted bigram where it was seen, else alpha times the lower order, whose unseen words share what the
unigram discounts leave. Counts above K lose TAIL of a count, so that every context keeps mass for unseen words.

N-grams are compared by 64-bit hashes: two of n distinct ones meet with probability n*n / 2**65.

Defined results: null is the empty text, which has the end token only; rows with a null doc_id are training rows; repeated
rows count and score each; with no training rows every token has probability 1; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.llm.shared import ascii_lower, partitions, word_hashes, written

#: Documents and tokens of a block, at most (a longer document is a block of its own).
DOCS, TOKENS = 2_000, 1_200_000
#: Counts up to K are discounted by Good-Turing.
K = 5
TAIL = 0.05
#: What a block's own row holds of its documents.
DOCUMENT = ("held", "n_tokens", "n_known", "base", "value")
END, START = np.uint64(0x5BD1E995A7C3F217), np.uint64(0x27D4EB2F165667C5)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack(a: np.ndarray) -> bytes:
    """Bytes by significance, which the shuffle's compression shortens where high bytes are zero."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


class Block:
    """The n-grams of some documents: vocabulary hashes, a code for each token, distinct (context, word) pairs."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, vocab: np.ndarray, code: np.ndarray):
        self.held, self.vocab, self.code = held, vocab, code
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(lengths) - lengths
        v = len(vocab)
        context = np.append(v, code[:-1])
        context[first] = v  # the start symbol, beyond the vocabulary
        self.pairs, self.pair = np.unique(context.astype(np.int64) * (v + 1) + code, return_inverse=True)
        self.context, self.word = self.pairs // (v + 1), self.pairs % (v + 1)
        self.keys = {1: vocab, 2: mix(np.append(vocab, START)[self.context] * np.uint64(0x9E3779B97F4A7C15) ^ mix(vocab[self.word]))}

    @staticmethod
    def of(lengths: np.ndarray, held: np.ndarray, h: np.ndarray) -> Block:
        """lengths: words of each document; h: their hashes. Each document gets its end token."""
        ends = np.cumsum(lengths + 1) - 1
        token = np.empty(len(h) + len(lengths), np.uint64)
        token[ends] = END
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = h
        vocab, code = np.unique(token, return_inverse=True)
        return Block(lengths + 1, held, vocab, code)

    def counts(self, order: int) -> np.ndarray:
        train = ~self.held[self.doc]
        of = self.code if order == 1 else self.pair
        return np.bincount(of[train], minlength=len(self.keys[order])).astype(np.uint32)

    def dealt(self, order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which n-grams are sent, by partition and key, and where partitions begin."""
        key = self.keys[order]
        part = key % np.uint64(parts)
        by = np.lexsort((key, part))
        return by, np.searchsorted(part[by], np.arange(parts + 1))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(block number, rows, words of each row): the same numbers for the same rows in every pass over a table.

    A number comes from the block's place and from the hashes of its words, so answers can never meet a block of other rows; if
    a pass should deal rows otherwise than the one before, it finds no answers and fails (score_udf)."""
    place = TaskContext.get().partitionId() << 32
    for batch in batches:
        words = pc.list_value_length(batch.column("_h")).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.append(0, np.cumsum(words + 1))
        a = 0
        while a < batch.num_rows:
            b = min(a + DOCS, max(a + 1, int(np.searchsorted(total, total[a] + TOKENS, side="right")) - 1))
            rows = batch.slice(a, b - a)
            content = np.concatenate([words[a:b].astype(np.uint64), rows.column("_h").flatten().to_numpy(zero_copy_only=False).astype(np.uint64)])
            with np.errstate(over="ignore"):
                digest = int(mix(content + np.arange(len(content), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum() ^ mix(np.array([place], np.uint64))[0])
            yield digest >> 2, rows, words[a:b]
            place, a = place + 1, b


def block_of(rows: pa.RecordBatch, words: np.ndarray) -> Block:
    return Block.of(words, rows.column("held").to_numpy(zero_copy_only=False), rows.column("_h").flatten().to_numpy(zero_copy_only=False).astype(np.uint64))


def send_udf(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, words in slices(batches):
            block = block_of(rows, words)
            for order in (1, 2):
                by, cuts = block.dealt(order, parts)
                key, count = block.keys[order][by], block.counts(order)[by]
                at = np.flatnonzero(np.diff(cuts))
                columns = [at.astype(np.int32), np.full(len(at), number), np.full(len(at), order, np.int32), [pack_sorted(key[cuts[p] : cuts[p + 1]]) for p in at], [pack(count[cuts[p] : cuts[p + 1]]) for p in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "block", "n", "keys", "counts"])

    return send


def total_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the blocks' n-grams of some partitions -> answers to the blocks, and a row of counts of counts (block -1)."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, block, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "keys", "counts")), strict=True):
            found.setdefault((part, n), []).append((block, keys, counts))
    while found:
        (part, n), sent = found.popitem()
        keys = [unpack_sorted(x[1]) for x in sent]
        key = np.concatenate(keys)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([unpack(x[2], np.uint32) for x in sent])).astype(np.int64)
        owner = np.zeros(len(key), bool)
        owner[first] = True
        answer = total[inverse].astype(np.uint32)
        cuts = np.cumsum([0, *map(len, keys)])
        spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        histogram = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
        statistics = np.array([total.sum(), (total > 0).sum(), *histogram], np.int64)
        columns = [
            pa.array([*(x[0] for x in sent), -1], pa.int64()),
            pa.array([part] * (len(sent) + 1), pa.int32()),
            pa.array([n] * (len(sent) + 1), pa.int32()),
            pa.array([*(pack(answer[s]) for s in spans), None], pa.binary()),
            pa.array([*(np.packbits(owner[s]).tobytes() for s in spans), None], pa.binary()),
            pa.array([None] * len(sent) + [statistics.tolist()], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "n", "totals", "owners", "statistics"])


def katz(ratio: np.ndarray, tail: float) -> np.ndarray | None:
    """Discounts from r* / r and the mass that counts above K would lose; None unless all lie between 0 and 1."""
    d = (ratio - tail) / (1 - tail) if tail < 1 else np.zeros(K)
    return np.append(1.0, d) if ((d > 0) & (d < 1)).all() else None


def discounts(statistics: list[int]) -> np.ndarray:
    """d[r] for r = 0..K: the share of a count r that Katz's estimate keeps, from counts of counts n_1..n_(K+1).

    Copies of documents leave bumps in counts of counts. Where these give no shares between 0 and 1, their log-linear fit
    takes their place, and where that doesn't fall steeply enough (tiny corpora), half a count is taken off."""
    n, r = np.array(statistics[2:], float), np.arange(1, K + 1)
    d = None
    if (n > 0).all():
        d = katz((r + 1) * n[1:] / (r * n[:-1]), (K + 1) * n[K] / n[0])
    if d is None and (n > 0).sum() > 1:
        slope = np.polyfit(np.log(np.flatnonzero(n) + 1), np.log(n[n > 0]), 1)[0]
        if slope < -1:
            d = katz(((r + 1) / r) ** (slope + 1), float(K + 1) ** (slope + 1))
    return np.append(1.0, (r - 0.5) / r) if d is None else d


def kept(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(count <= K, d[np.minimum(count, K)] * count, count - TAIL)


def unseen_mass(statistics: list[int], d: np.ndarray) -> float:
    """What the unigram discounts leave for words never seen."""
    total, distinct, *n = statistics
    if not total:
        return 1.0
    low = sum(r * n[r - 1] for r in range(1, K + 1))
    mass = sum(d[r] * r * n[r - 1] for r in range(1, K + 1)) + (total - low) - TAIL * (distinct - sum(n[:K]))
    return 1.0 - mass / total


def blocks_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks themselves, coded, for the pass that meets the answers."""
    for number, rows, words in slices(batches):
        block = block_of(rows, words)
        columns = [pa.array([number]), pa.array([rows.column("doc_id").to_pylist()], pa.list_(rows.column("doc_id").type)), pa.array([pack(words + 1)]), pa.array([np.packbits(block.held).tobytes()]), pa.array([pack(block.vocab)]), pa.array([pack(block.code.astype(np.uint32))])]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "lengths", "held", "vocab", "code"])


def score_udf(one: list[int], two: list[int], parts: int, kind: pa.DataType):
    d1, d2 = discounts(one), discounts(two)
    p0, total, distinct = unseen_mass(one, d1), one[0], one[1]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or not right.num_rows:
            raise ValueError("the rows of a block changed between two passes over the documents")
        row = left.to_pylist()[0]
        lengths = unpack(row["lengths"], np.int64)
        docs = len(lengths)
        held = np.unpackbits(np.frombuffer(row["held"], np.uint8))[:docs].astype(bool)
        block = Block(lengths, held, unpack(row["vocab"], np.uint64), unpack(row["code"], np.uint32).astype(np.int64))
        count, owned = {}, {}
        for n in (1, 2):
            by, cuts = block.dealt(n, parts)
            count[n], owned[n] = np.zeros(len(by), np.int64), np.zeros(len(by), bool)
            answers = right.filter(pc.equal(right["n"], n))
            for part, totals, owners in zip(*(answers[c].to_pylist() for c in ("part", "totals", "owners")), strict=True):
                to = by[cuts[part] : cuts[part + 1]]
                count[n][to] = unpack(totals, np.uint32)
                owned[n][to] = np.unpackbits(np.frombuffer(owners, np.uint8))[: len(to)]
        c1, c2 = count[1], count[2]
        unigram = np.where(c1 > 0, kept(c1, d1) / max(total, 1), p0)
        end = c1[np.searchsorted(block.vocab, END)]  # as many texts start as end
        of_context = np.append(c1, end)[block.context]
        seen = c2 > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(seen, np.log10(kept(c2, d2) / of_context), np.log10(unigram[block.word]))
        base = np.log10((c1 + 0.5) / (total + 0.5 * (distinct + 1)))
        per_doc = lambda x: np.bincount(block.doc, weights=x, minlength=docs)
        number = row["block"]
        sent = {name: [] for name in ("part", "block", "ids", "held", "n_tokens", "n_known", "base", "value", "keys", "masses", "ask", "ask_doc", "ask_n")}

        def add(**x):
            for name, values in sent.items():
                values.append(x.get(name))

        add(part=int(number % parts), block=number, ids=row["ids"], held=row["held"], n_tokens=pack(lengths), n_known=pack(per_doc(c1[block.code] > 0).astype(np.int64)), base=pack(per_doc(base[block.code])), value=pack(per_doc(value[block.pair])))
        mine = owned[2] & seen
        context_key = mix(np.append(block.vocab, START))
        width = len(context_key)
        seen_mass = np.bincount(block.context[mine], weights=(kept(c2, d2) / np.maximum(of_context, 1))[mine], minlength=width)
        lower_mass = np.bincount(block.context[mine], weights=unigram[block.word[mine]], minlength=width)
        back = (~seen & (of_context > 0))[block.pair]
        asked, n_asked = np.unique(block.context[block.pair[back]] * docs + block.doc[back], return_counts=True)
        part = (context_key % np.uint64(parts)).astype(np.int64)
        holds, asks = np.flatnonzero(seen_mass > 0), asked // docs
        holds = holds[np.lexsort((context_key[holds], part[holds]))]
        by_part = np.argsort(part[asks], kind="stable")
        hold_cuts, ask_cuts = (np.searchsorted(p, np.arange(parts + 1)) for p in (part[holds], part[asks][by_part]))
        for p in range(parts):
            h, a = holds[hold_cuts[p] : hold_cuts[p + 1]], by_part[ask_cuts[p] : ask_cuts[p + 1]]
            if len(h) or len(a):
                wanted, place = np.unique(context_key[asks[a]], return_inverse=True)
                add(part=p, block=number, keys=pack_sorted(context_key[h]), masses=seen_mass[h].tobytes() + lower_mass[h].tobytes(), ask=pack_sorted(wanted), ask_doc=pack((place * docs + asked[a] % docs).astype(np.uint64)), ask_n=pack(n_asked[a].astype(np.uint32)), n_tokens=pack(np.array([docs], np.int64)))
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(kind)), *((name, pa.binary()) for name in list(sent)[3:])])
        return pa.table(sent, schema=schema)

    return score


def alpha_udf(kind: pa.DataType):
    def alpha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Masses and questions of some partitions -> one row for each asking block, what the back-off weights add to its
        documents; the blocks' own rows pass through."""
        masses: dict[int, list] = {}
        asks: dict[int, list] = {}
        names = ["block", "ids", *DOCUMENT, "places", "added"]
        types = [pa.int64(), pa.list_(kind), *[pa.binary()] * (len(DOCUMENT) + 2)]
        for batch in batches:
            own = batch.filter(pc.is_valid(batch.column("ids")))
            if own.num_rows:
                columns = [own.column(c) for c in names[:-2]] + [pa.nulls(own.num_rows, pa.binary())] * 2
                yield pa.RecordBatch.from_arrays(columns, names=names)
            rest = batch.filter(pc.is_null(batch.column("ids"))).select(["part", "block", "n_tokens", "keys", "masses", "ask", "ask_doc", "ask_n"])
            for row in rest.to_pylist():
                both = np.frombuffer(row["masses"], np.float64).reshape(2, -1)
                masses.setdefault(row["part"], []).append((unpack_sorted(row["keys"]), both))
                if row["ask_n"]:
                    asks.setdefault(row["part"], []).append(row)
        while asks:
            part, questions = asks.popitem()
            key, inverse = np.unique(np.concatenate([x[0] for x in masses[part]]), return_inverse=True)
            seen, lower = (np.bincount(inverse, weights=np.concatenate([x[1][i] for x in masses[part]])) for i in (0, 1))
            weight = np.log10((1 - seen) / (1 - lower))
            for row in questions:
                docs = int(unpack(row["n_tokens"], np.int64)[0])
                wanted = weight[np.searchsorted(key, unpack_sorted(row["ask"]))]
                pair = unpack(row["ask_doc"], np.uint64).astype(np.int64)
                added = np.bincount(pair % docs, weights=wanted[pair // docs] * unpack(row["ask_n"], np.uint32), minlength=docs)
                at = np.flatnonzero(added)
                values = [row["block"], None, *[None] * len(DOCUMENT), at.tobytes(), added[at].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    return alpha


def collect_udf(kind: pa.DataType):
    def collect(rows: pa.Table) -> pa.Table:
        """A block's own row and what was added to it -> a row for each document."""
        own = rows.filter(pc.is_valid(rows["ids"])).to_pylist()[0]
        n = len(own["ids"])
        score = unpack(own["value"], np.float64).copy()
        for places, added in zip(rows["places"].to_pylist(), rows["added"].to_pylist(), strict=True):
            if places is not None:
                score[np.frombuffer(places, np.int64)] += np.frombuffer(added, np.float64)
        held = np.unpackbits(np.frombuffer(own["held"], np.uint8))[:n].astype(bool)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        columns = [pa.array(own["ids"], kind), held, unpack(own["n_tokens"], np.int64), unpack(own["n_known"], np.int64), unpack(own["base"], np.float64), score]
        return pa.table(dict(zip(names, columns, strict=True)))

    return collect


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def katz_scores(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held marks the documents from which nothing is learnt; all are scored."""
    spark = docs.sparkSession
    parts = partitions(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select("doc_id", held.alias("held"), word_hashes(ascii_lower(F.col("text"))).alias("_h"))
    sent = rows.mapInArrow(send_udf(parts), "part int, block bigint, n int, keys binary, counts binary")
    answers = sent.repartition(parts, "part").mapInArrow(total_udf, "block bigint, part int, n int, totals binary, owners binary, statistics array<bigint>")
    answers = written(answers, "counts")
    sums = answers.where("block = -1").groupBy("n").agg(*[F.sum(F.col("statistics")[i]).alias(f"s{i}") for i in range(K + 3)]).collect()
    statistics = {r["n"]: [int(r[f"s{i}"]) for i in range(K + 3)] for r in sums}
    one, two = (statistics.get(n, [0] * (K + 3)) for n in (1, 2))
    blocks = rows.mapInArrow(blocks_udf, f"block bigint, ids array<{id_type}>, lengths binary, held binary, vocab binary, code binary")
    answers = answers.where("block >= 0").drop("statistics")
    names = ("held", "n_tokens", "n_known", "base", "value", "keys", "masses", "ask", "ask_doc", "ask_n")
    schema = f"part int, block bigint, ids array<{id_type}>, " + ", ".join(f"{x} binary" for x in names)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_udf(one, two, parts, kind), schema)
    through = f"block bigint, ids array<{id_type}>, " + ", ".join(f"{x} binary" for x in (*DOCUMENT, "places", "added"))
    by_part = scored.repartition(parts, "part").mapInArrow(alpha_udf(kind), through)
    out = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    final = by_part.groupBy("block").applyInArrow(collect_udf(kind), out)
    return final.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(one[0]).cast("bigint").alias("train_tokens"), "base_score", "score")
