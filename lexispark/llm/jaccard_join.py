"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct n-word shingles; documents with equal sets are one node. The shingle universe is hashed
into segments; how many there are depends on the size band of the larger document of a pair. Two sets that reach the similarity
differ in at most H elements, so if segments have allocations (1: the segment itself is indexed; 2: the segment and its
one-deletion neighbourhood) that sum to H + 1 + 2 * s, the segments on which the pair agrees hold at least 1 + 2 * s of it.
The allocation of a band is the cheapest by a cost model: index entries against how weak the segments' signatures are.

Where no segment has allocation 2 there are SEGMENTS * H segments, and a document that can differ from its partners in D elements
indexes only D + KEPT of them: the first in an order of signatures that is the same for all documents. Linked documents share all
but D segments at least, and what each leaves out of these comes last in that order, so KEPT of them are indexed by both. The order
puts signatures last that many documents have, by how often their rarest shingle occurs in a bounded sample of documents: pages made
from one template share the frequent ones alone and don't meet. Any order gives the same links, so the sample decides only how much work there is. Small sets, whose segments may have
allocation 2, leave out their weakest segments up to s - 1 and so share several signatures too.

Signatures meet in one shuffle. What follows works on pairs, and a pair is verified before it joins anything:
1. each node is compared with the one node with which it shares most signatures; links make components;
2. in signature groups that still hold several components, pairs across components are candidates if sizes allow the similarity and
   if their parity sketches differ in at most H bits (each element flips one bit, so more bits mean more differing elements). Each
   component is compared with another at the pair whose sketches differ least, and links join them; this is repeated as long as one
   in eight comparisons finds a link, so that near copies become one component in a few comparisons each;
3. all candidates between components left are compared that share as many signatures as the pigeonhole promises.
Every link lies in one component after the first two steps or is a candidate of the third, so none is lost, while a group of
thousands of near copies needs a comparison for each, not for each two. Texts travel once for each comparison with their hub; hubs
with many partners and signature groups with many members are split.

Shingles are compared by 64-bit hashes: two of n distinct shingles meet with probability n*n / 2**65.

Defined results: null texts and texts without words have the empty set and link with nothing (each row is its own component);
fewer words than n are one shingle; rows that repeat a doc_id each get a row; a null doc_id counts as larger than any other when
the smallest is sought and is returned as null only where nothing else is reachable; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.shared import ascii_lower, discard, joined_small, partitions, word_hashes, written

#: How many index entries a signature that rests on two shingles or fewer is worth.
WEAK = 3.0
#: Members of a signature group, and partners of a hub, that are handled together; larger groups are split.
BLOCK = 2048
PARTNERS = 512
#: Documents whose signatures are made together.
ROWS = 500
#: Lists of a node's candidates that are counted apart.
SLOTS = 4
#: Bits of a parity sketch: this times the differences that a link allows, between these. With fewer, elements that differ often
#: flip the same bit, and sets well below the similarity pass.
SKETCH_SPREAD = 8
#: Signatures that linked documents share at least, and segments for each difference that a link allows.
KEPT, SEGMENTS = 3, 3
#: Documents and frequent shingles that the order of signatures rests on, at most: what is sent to all tasks is 16 bytes for each shingle.
SAMPLE, FREQUENT = 10_000, 500_000
SKETCH_BITS = (64, 8192)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of documents (offsets: where each starts) -> distinct shingle hashes, sorted by document and hash, and their documents."""
    h = h.astype(np.uint64)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(h)) - offsets[:-1][doc] if len(h) else np.zeros(0, np.int64)
    size = np.minimum(n, lengths)[doc] if len(h) else np.zeros(0, np.int64)
    starts = np.flatnonzero(place + size <= lengths[doc]) if len(h) else np.zeros(0, np.int64)
    value = np.zeros(len(starts), np.uint64)
    for k in range(n):
        has = size[starts] > k
        at = np.minimum(starts + k, max(len(h) - 1, 0))
        value = np.where(has, mix(value ^ h[at], k + 1), value)
    doc = doc[starts]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], doc[fresh]


@lru_cache(maxsize=8)
def band_edges(percent: int, most: int) -> np.ndarray:
    """Lower ends of the size bands; a set can only reach the similarity with sets of its own band or a neighbouring one."""
    edges = [1]
    while len(edges) < 3 or edges[-3] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return np.array(edges, np.int64)


def most_differences(largest: int, percent: int) -> int:
    """H: in how many elements two linked sets of at most this size can differ."""
    return (100 - percent) * 2 * largest // (100 + percent)


def spare(largest: int, percent: int) -> int:
    """s: half of what allocations sum to beyond H + 1."""
    return 2 + most_differences(largest, percent) // 16


def left_out(largest: int, percent: int) -> int:
    """Weight of a document's allocation that may be left out of the index."""
    return spare(largest, percent) - 1


@lru_cache(maxsize=4096)
def allocation(largest: int, percent: int) -> tuple[int, int]:
    """(segments, how many of them have allocation 2) for sets of at most this size, by least cost."""
    need = most_differences(largest, percent) + 1 + 2 * spare(largest, percent)
    best = (math.inf, need, 0)
    for twos in range(need // 2 + 1):
        m = need - twos
        load = largest / m
        weak = math.exp(-load) * (1 + load + load * load / 2)
        best = min(best, (m + twos * load + WEAK * weak * m, m, twos))
    return best[1], best[2]


def segments(largest: int, percent: int) -> tuple[int, int]:
    """(segments, how many of them have allocation 2) that are indexed for sets of at most this size."""
    m, twos = allocation(largest, percent)
    return (m, twos) if twos else (SEGMENTS * most_differences(largest, percent) + KEPT, 0)


def band_signatures(value: np.ndarray, doc: np.ndarray, band: np.ndarray, upper: np.ndarray, percent: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets under given bands. value, doc: set elements sorted by document; band, upper: per document; often: how often
    each element occurs in the sample -> (signature, document)."""
    out_s, out_d = [], []
    for b in np.unique(band[doc]) if len(doc) else ():
        largest = int(upper[np.flatnonzero(band == b)[0]])
        if most_differences(largest, percent) == 0:
            continue  # only equal sets link, and they are one node
        m, twos = segments(largest, percent)
        here = band[doc] == b
        v, d = value[here], doc[here]
        docs, local = np.unique(d, return_inverse=True)
        segment = (mix(v, 77) % np.uint64(m)).astype(np.int64)
        cell = local * m + segment
        cells = len(docs) * m
        element = mix(v, 1013)
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, element)
        count = np.bincount(cell, minlength=cells)
        name = mix(np.tile(np.arange(m, dtype=np.uint64), len(docs)), int(b) + 5000)
        signature = mix(total ^ name, 3)
        if twos:
            weight = np.where(np.arange(m) < twos, 2, 1)
            by_load = np.argsort(count.reshape(-1, m), axis=1, kind="stable")
            skip = np.zeros((len(docs), m), bool)
            np.put_along_axis(skip, by_load, np.cumsum(weight[by_load], axis=1) <= left_out(largest, percent), axis=1)
            keep = ~skip.ravel()
        else:
            rarest = np.full(cells, np.iinfo(np.int64).max)
            np.minimum.at(rarest, cell, often[here])
            order = np.lexsort((signature, -count, rarest, np.repeat(np.arange(len(docs)), m)))
            apart = (100 - percent) * (np.bincount(local) + largest) // (100 + percent)
            keep = np.zeros(cells, bool)
            keep[order.reshape(-1, m)[np.arange(m) < (apart + KEPT)[:, None]]] = True
        out_s.append(signature[keep])
        out_d.append(np.repeat(docs, m)[keep])
        near = np.flatnonzero((segment < twos) & keep[cell])
        if len(near):
            c = cell[near]
            with np.errstate(over="ignore"):
                out_s.append(mix((total[c] - element[near]) ^ name[c], 3))
            out_d.append(d[near])
    if not out_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_d)


def node_names(value: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A 64-bit name of each document's set: equal sets have equal names."""
    digest = np.zeros(docs, np.uint64)
    np.add.at(digest, doc, mix(value, 31))
    return mix(digest ^ np.bincount(doc, minlength=docs).astype(np.uint64), 7).astype(np.int64)


def sketch_widths(size: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the sketch of each set: a power of two."""
    wanted = np.maximum(SKETCH_SPREAD * ((100 - percent) * 2 * size // (100 + percent)), 1)
    return np.clip(2 ** np.ceil(np.log2(wanted)).astype(np.int64), *SKETCH_BITS)


def sketches(value: np.ndarray, doc: np.ndarray, size: np.ndarray, percent: int) -> pa.Array:
    """Parity sketches: every element flips one bit. A sketch folds to half its width by xor of its halves."""
    width = sketch_widths(size, percent)
    start = np.append(0, np.cumsum(width))
    at = start[doc] + (mix(value, 991) & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.bincount(at, minlength=start[-1]) & 1
    data = np.packbits(bits.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(data)])


def batch_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of the word hashes of a batch."""
    lists = batch.column("_h")
    offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
    return shingle_sets(lists.flatten().to_numpy(zero_copy_only=False), offsets, n)


def frequent_shingles(lists: DataFrame, n: int):
    """Shingles that several documents of a bounded sample have, with how many do: sorted arrays on all executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, times = np.unique(batch_sets(batch, n)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(times)], names=["value", "times"])

    spark = lists.sparkSession
    share = min(1.0, SAMPLE / max(1, lists.count()))
    chosen = lists.where(F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("_h")
    found = chosen.mapInArrow(count, "value bigint, times bigint").groupBy("value").agg(F.sum("times").alias("times")).where("times > 2")
    rows = found.orderBy(F.col("times").desc(), "value").limit(FREQUENT).toArrow()
    value, times = (rows[c].to_numpy() for c in ("value", "times"))
    order = np.argsort(value.astype(np.uint64))
    return spark.sparkContext.broadcast((value.astype(np.uint64)[order], times[order]))


def sets_udf(n: int, percent: int, frequent):
    """Rows of two kinds: for each document its name, set size, node and sketch (doc); and its signatures (doc is null)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        shingles, times = frequent.value
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                value, doc = batch_sets(batch, n)
                often = np.zeros(len(value), np.int64)
                if len(shingles):
                    place = np.minimum(np.searchsorted(shingles, value), len(shingles) - 1)
                    often = np.where(shingles[place] == value, times[place], 0)
                docs = batch.num_rows
                size = np.bincount(doc, minlength=docs).astype(np.int64)
                node = node_names(value, doc, docs)
                edges = band_edges(percent, int(size.max(initial=1)))
                own = np.searchsorted(edges, np.maximum(size, 1), side="right") - 1
                fresh = np.zeros(docs, bool)  # copies inside the batch are indexed once
                fresh[np.unique(node, return_index=True)[1]] = True
                found = []
                for up in (0, 1):
                    reaches = (edges[own + up] * percent <= 100 * size) & (size > 0)
                    use = (reaches & fresh)[doc]
                    found.append(band_signatures(value[use], doc[use], own + up, edges[own + 1 + up] - 1, percent, often[use]))
                sig, place = (np.concatenate(x) for x in zip(*found, strict=True))
                about = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(size), sketches(value, doc, size, percent)], names=["doc_id", "rid", "size", "sketch"])
                spread = mix(np.arange(at, at + docs, dtype=np.uint64) ^ node.astype(np.uint64), 5).astype(np.int64)
                at += docs
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(node), about], names=["sig", "node", "doc"])
                for b in range(0, len(sig), 50_000):
                    part = slice(b, b + 50_000)
                    columns = [pa.array(sig[part].astype(np.int64)), pa.array(node[place[part]])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), about.type)], names=["sig", "node", "doc"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return sets


def differing_bits(column: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the sketches at places x and y of a column differ, the wider ones folded."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    flat = np.frombuffer(column.buffers()[2], np.uint64)
    words = np.diff(start)
    out = np.zeros(len(x), np.int64)
    narrow = np.minimum(words[x], words[y])
    for w in np.unique(narrow):
        at = np.flatnonzero(narrow == w)
        a, b = start[x[at]], start[y[at]]
        turns_a, turns_b = words[x[at]] // w, words[y[at]] // w
        for k in range(w):
            bits = flat[a + k] ^ flat[b + k]
            for first, turns in ((a, turns_a), (b, turns_b)):
                for t in range(1, int(turns.max())):
                    bits ^= np.where(turns > t, flat[np.minimum(first + k + t * w, len(flat) - 1)], np.uint64(0))
            out[at] += np.bitwise_count(bits)
    return out


@lru_cache(maxsize=100_000)
def promised(larger: int, differences: int, percent: int) -> int:
    """How many signatures two sets share at least if they differ in no more elements than this."""
    edges = band_edges(percent, larger)
    largest = int(edges[np.searchsorted(edges, larger, side="right")]) - 1
    m, twos = segments(largest, percent)
    if not twos:
        return KEPT
    weight = m + twos - differences - 2 * left_out(largest, percent)
    return -(-weight // 2)


def pairs_udf(percent: int, best: bool):
    """Members of signature groups, group by group -> pairs across components that sizes and sketches allow, as lists: u, slot (of v), v and
    need (how many signatures a link would have to share), bits (in which sketches differ) and component. With best one pair, of
    fewest bits, for each component of a group."""

    def candidates(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        number = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        sig, i, j, own, node, root, size = (number(c) for c in ("sig", "i", "j", "own", "node", "root", "size"))
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.cumsum(fresh)
        at, step, found = np.arange(len(sig)), 1, []
        while True:
            at = at[at + step < len(sig)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            to = at + step
            small, large = np.minimum(size[at], size[to]), np.maximum(size[at], size[to])
            use = (root[at] != root[to]) & (node[at] != node[to]) & (100 * small >= percent * large) & ((own[at] != own[to]) | (i[at] == j[at]))
            x, y, most = at[use], to[use], ((100 - percent) * (small + large) // (100 + percent))[use]
            bits = differing_bits(rows.column("sketch"), x, y)
            near = bits <= most
            if near.any():
                found.append((x[near], y[near], most[near], bits[near]))
            step += 1
        if not found:
            return None
        x, y, most, bits = (np.concatenate(f) for f in zip(*found, strict=True))
        of = group[x]
        component = np.zeros(len(x), np.int64)
        if best:
            x, y, most, bits, of = (np.concatenate((f, f)) for f in (x, y, most, bits, of))
            half = len(x) // 2
            component = np.concatenate((root[x[:half]], root[y[half:]]))
            order = np.lexsort((node[y], node[x], bits, component, of))
            order = order[np.append(True, (np.diff(of[order]) != 0) | (np.diff(component[order]) != 0))]
            x, y, most, bits, of, component = (f[order] for f in (x, y, most, bits, of, component))
        u, v = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        need = np.array([promised(int(m), int(d), percent) for m, d in zip(np.maximum(size[x], size[y]), most, strict=True)], np.int64)
        slot = (mix(v.astype(np.uint64), 17) % np.uint64(SLOTS)).astype(np.int64)
        order = np.lexsort((slot, u, component, of))
        u, v, need, slot, bits, of, component = (f[order] for f in (u, v, need, slot, bits, of, component))
        new = np.append(True, (np.diff(of) != 0) | (np.diff(component) != 0) | (np.diff(u) != 0) | (np.diff(slot) != 0))
        ends = pa.array(np.append(np.flatnonzero(new), len(u)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(f)) for f in (v, need)]
        columns = [pa.array(u[new]), pa.array(slot[new]), *lists, pa.array(bits[new]), pa.array(component[new])]
        return pa.RecordBatch.from_arrays(columns, names=["u", "slot", "v", "need", "bits", "component"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")], axis=1)
            start = np.flatnonzero((keys != keys[-1]).any(axis=1))
            last = int(start[-1]) + 1 if len(start) else 0  # where the batch's last group begins
            if last or (held and any(held[-1].column(c)[-1].as_py() != k for c, k in zip(("sig", "i", "j"), keys[0].tolist(), strict=True))):
                held.append(batch.slice(0, last))
                found = candidates(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                if found is not None:
                    yield found
                held = []
            held.append(batch.slice(last))
        if held:
            found = candidates(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if found is not None:
                yield found
        pa.default_memory_pool().release_unused()

    return pairs


def often_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of a node's candidates, one for each signature group -> the pairs that occur as often as a link would."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        v, need = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("v", "need"))
        order = np.lexsort((need, v, row))
        row, v, need = row[order], v[order], need[order]
        starts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(v) != 0)))[: len(row)]
        fine = starts[np.diff(np.append(starts, len(row))) >= need[starts]] if len(row) else starts
        yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(row[fine])), pa.array(v[fine])], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): alternating large-star and small-star rounds until nothing changes."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.where("u <> v").distinct(), "edges")
        discard(before)
        name = F.xxhash64("u", "v")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(name), F.sum(name.cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state


def verify_udf(n: int, percent: int):
    """Word hashes by (hub, salt), the hub's own first -> (hub, node) where the sets of both are linked. Equal rows follow one another."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                value, doc = batch_sets(batch, n)
                cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                u, v = [], []
                for k, (of, node) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                    mine = value[cuts[k] : cuts[k + 1]]
                    if of == node:
                        hub, own = of, mine
                    elif of == hub:
                        common = len(np.intersect1d(own, mine, assume_unique=True))
                        if 100 * common >= percent * (len(own) + len(mine) - common):
                            u.append(of)
                            v.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        pa.default_memory_pool().release_unused()

    return verify


def row_name() -> Column:
    """A 64-bit name of a row, which rows equal in doc_id and text share."""
    return F.xxhash64("doc_id", "text")


def linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs (u, v) of nodes -> those that are linked. nodes: node, rid (the row from which its set can be made)."""
    parts = partitions(docs.sparkSession)
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("_n"))
    dealt = pairs.join(many.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
    dealt = dealt.select(F.col("u").alias("hub"), F.pmod(F.xxhash64("v"), F.col("_n")).cast("int").alias("salt"), F.col("v").alias("node"))
    wanted = dealt.unionByName(dealt.select("hub", "salt", F.col("hub").alias("node")).distinct())
    wanted = wanted.join(nodes.select(F.col("node").alias("_node"), F.col("rid").alias("_rid")), F.col("node") == F.col("_node")).select("hub", "salt", "node", "_rid")
    texts = joined_small(docs.select(row_name().alias("rid"), "text"), written(wanted, "wanted"), F.col("rid") == F.col("_rid"))
    # texts are dealt out, which compress, and hashed where they arrive
    texts = texts.select("hub", "salt", "node", (F.col("hub") != F.col("node")).alias("leaf"), "text").repartition(parts, "hub", "salt")
    texts = texts.sortWithinPartitions("hub", "salt", "leaf", "node").select("hub", "node", word_hashes(ascii_lower(F.col("text"))).alias("_h"))
    return texts.mapInArrow(verify_udf(n, percent), "u bigint, v bigint").distinct()


def across(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met (sig, node) -> sig, node, root and the number of members of the signature groups that hold several components."""
    labelled = met.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    group = W.partitionBy("sig")
    labelled = labelled.select("sig", "node", F.coalesce("root", "node").alias("root")).distinct()
    labelled = labelled.select("*", F.min("root").over(group).alias("_low"), F.max("root").over(group).alias("_high"), F.count(F.lit(1)).over(group).alias("_k"))
    return labelled.where("_low <> _high").drop("_low", "_high")


def candidate_pairs(met: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, best: bool) -> DataFrame:
    """met (sig, node): members of signature groups -> candidate pairs (u, v) across components: the best of each component, or all."""
    parts = partitions(met.sparkSession)
    labelled = across(met, roots).withColumn("_blocks", F.ceil(F.col("_k") / BLOCK).cast("int"))
    labelled = labelled.withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    members = labelled.join(nodes.select(F.col("node").alias("_node"), "size", "sketch"), F.col("node") == F.col("_node"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    members = members.select("sig", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "node", "root", "size", "sketch")
    members = members.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    pairs = members.mapInArrow(pairs_udf(percent, best), "u bigint, slot bigint, v array<bigint>, need array<bigint>, bits bigint, component bigint")
    if best:
        first = pairs.groupBy("component").agg(F.min(F.struct("bits", "u", F.col("v")[0].alias("v"))).alias("_pair"))
        return first.select("_pair.u", "_pair.v").distinct()
    gathered = pairs.groupBy("u", "slot").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("v", "need")))
    return gathered.select("u", "v", "need").mapInArrow(often_enough, "u bigint, v bigint")


def as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, rid, n_shingles, root: rows of linked documents share a root; null without words."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    lists = docs.select("doc_id", row_name().alias("rid"), word_hashes(ascii_lower(F.col("text"))).alias("_h"))
    schema = f"sig bigint, node bigint, doc struct<doc_id: {kind.simpleString()}, rid: bigint, size: bigint, sketch: binary>"
    found = lists.mapInArrow(sets_udf(n, percent, frequent_shingles(lists, n)), schema)
    # documents travel beside the signatures, which so needn't be made twice; their keys spread them evenly
    group = W.partitionBy("sig", "_is_doc")
    found = found.withColumn("_is_doc", F.col("doc").isNotNull())
    found = found.select("*", F.min("node").over(group).alias("head"), F.max("node").over(group).alias("_last"))
    found = written(found.where("_is_doc OR head <> _last").select("sig", "node", "doc", "head"), "met")
    rows = found.where("doc IS NOT NULL").select("node", "doc.*")
    met = found.where("doc IS NULL")
    nodes = written(rows.where("size > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "nodes")

    stars = met.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
    stars = stars.groupBy("node").agg(F.max_by("head", F.struct("c", "head")).alias("u")).select("u", F.col("node").alias("v"))
    first = written(linked(docs, nodes, stars, n, percent), "links")
    roots = written(connected_components(first), "roots")
    # a link between two components makes their other candidates needless, so all that are left are compared last
    met, best = met.select("sig", "node"), True
    while True:
        pairs = written(candidate_pairs(met, nodes, roots, percent, best), "pairs")
        links = written(linked(docs, nodes, pairs, n, percent), "links")
        if joined := links.count():
            roots = written(connected_components(as_edges(roots).unionByName(links)), "roots")
        if not best or not (compared := pairs.count()):
            break  # all candidates have been compared, or there are none
        best = 8 * joined >= compared
    rows = rows.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return rows.select("doc_id", "rid", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("root", "node")).alias("root"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: documents linked when 100 * intersection >= percent * union."""
    rows = written(components(docs, n, percent), "components")
    smallest = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("_least"))
    rows = rows.join(smallest, F.col("root") == F.col("_root"), "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: of the rows with the smallest doc_id (null is largest) one stays. Rows without
    words link with nothing and stay."""
    rows = written(components(docs, n, percent).where("root IS NOT NULL"), "components")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    several = rows.join(first.where("_rows > 1").withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"))
    several = written(several.groupBy("rid").agg(F.min((F.col("_first.rid") == F.col("rid")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("times")), "copies")
    named = docs.withColumn("_rid", row_name())
    gone = several.where("stays = 0 OR times > 1").select(F.col("rid").alias("_gone"))
    left = joined_small(named, gone, F.col("_rid") == F.col("_gone"), "left_anti")
    # the few rows that stay but occur more than once are reduced to one
    again = joined_small(named, several.where("stays = 1 AND times > 1").select(F.col("rid").alias("_gone")), F.col("_rid") == F.col("_gone"), "left_semi").dropDuplicates(["_rid"])
    return left.unionByName(again).select(*docs.columns)
