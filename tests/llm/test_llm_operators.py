"""Each operator against brute force or the library that it stands for, on documents that hold the hard cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexispark.llm import byte_bpe, fingerprints, jaccard_join, lm_katz, mixing, quality_classifier, quality_rules, secret_scan, sharding, token_counts
from lexispark.llm.shared import ascii_lower, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, _row string"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def rows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "straße", "日本", "😀", "the", "a|b", "x#"]
    texts = [None, "", " \n\t ", "one", "one two", "One  two", "a" * 300, "le mot " * 40, "x<|endoftext|>y\x85z　w it's WE'LL 12٣½", "word\nline a\nline a\n\nline a"]
    for size in (9, 12, 25, 60, 120, 400):
        base = [r.choice(vocabulary) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(4):
            edited = list(base)
            for _ in range(r.randint(0, max(1, size // 40))):
                edited[r.randrange(size)] = r.choice(vocabulary)
            texts.append(" ".join(edited))
    texts += [texts[-1]] * 3 + [" ".join(r.choice(vocabulary) for _ in range(20_000))]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][i % 4 if i % 5 else 1], None, "clash", "clash") for i, t in enumerate(texts)]
    return out + [(5, "one  two again", "en", "s1", 3, "x", "y"), (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in df.collect()), key=str)


def test_byte_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows():
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert pairs(byte_bpe.encode_digests(docs, RANKS, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    for r in byte_bpe.encode_texts(docs.where("doc_id < 12"), RANKS, P.PATTERN).collect():
        assert encoding.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens
    assert byte_bpe.encode_digests(empty, RANKS, P.PATTERN).count() == 0


def test_byte_bpe_of_long_words(spark):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH"
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (65, 66, 200, 2_000, 100_000)]
    texts += ["a" * 9_999, "the" * 900, "-" * 1_000 + "=" * 777, " " * 3_000, "".join(chr(0x4E00 + r.randrange(3_000)) for _ in range(4_000)), "".join(r.choice("ab") for _ in range(3_000))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for x in byte_bpe.encode_texts(df, RANKS, P.PATTERN).collect():
        assert x.ids == encoding.encode_ordinary(texts[x.doc_id]) and x.decoded == texts[x.doc_id]


def test_byte_bpe_ids_alone(spark):
    """Without decoded texts nothing is decoded, and words that a task has forgotten or still knows get the same ids."""
    texts = [f"some word{i % 7} of text {i} " + "x" * (i % 3) * 70 for i in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = {r.doc_id: (r.n_tokens, r.ids) for r in byte_bpe.encode_texts(df, RANKS, P.PATTERN).collect()}
    for remembered in (3, 1_000):
        got = byte_bpe.encode_texts(df, RANKS, P.PATTERN, remembered=remembered, decode=False)
        assert got.columns == ["doc_id", "n_tokens", "ids"]
        assert {r.doc_id: (r.n_tokens, r.ids) for r in got.collect()} == want
    merger = byte_bpe.Merger(byte_bpe.load(RANKS), 10, packed=True, decode=False)
    ids, decoded, n = merger.look_up([b"hello world"])[0]
    assert decoded is None and len(ids) == 4 * n


def test_ranks_never_fall_while_a_token_forms():
    assert byte_bpe.load(RANKS).grows


def test_a_vocabulary_whose_ranks_fall_is_contracted_one_pair_at_a_time(spark, tmp_path):
    """abc is merged before its own part ab, which many contractions in a step would get wrong."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 300, b"ab": 290, b"abcd": 257, b"cd": 280, b"da": 270, b"dab": 258}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(i).encode() + b"\n" for t, i in ranks.items()))
    assert not byte_bpe.load(str(path)).grows
    encoding = tiktoken.Encoding("falling", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = {i: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 200))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for x in byte_bpe.encode_texts(df, str(path), P.PATTERN).collect():
        assert x.ids == encoding.encode_ordinary(texts[x.doc_id]) and x.decoded == texts[x.doc_id]


def test_token_counts(docs, empty):
    tokenizer = Tokenizer.from_file(JSON)
    want = []
    for r in rows():
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 1024))
    assert pairs(token_counts.token_counts(docs, JSON, P.PATTERN), "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.token_counts(empty, JSON, P.PATTERN).count() == 0


def longest_repeats(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i + 1, n):
            if words[i] == words[j]:
                k = 0
                while j + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs).collect()}
    for doc_id, text, *_ in rows():
        words = (text or "").encode().split()
        if len(words) > 500:
            continue
        r, repeats = got[(doc_id, len(words))], longest_repeats(words)
        again = {q for p, k in enumerate(repeats) if k >= 8 for q in range(p, p + 8)}
        covered = {q for p, k in enumerate(repeats) if k >= 5 for q in range(p, p + k)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert (r.n_repeat_words, r.n_covered_words, r.longest_repeat) == (len(again), len(covered), max(repeats, default=0))
        assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def linked(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, n, percent):
    texts = [(r[0], r[1]) for r in rows() if r[0] is not None and r[5] == "clash"]
    one = docs.where("doc_id IS NOT NULL AND shard = 'clash'")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(one, n, percent).collect()}
    assert got == linked(texts, n, percent)


def test_jaccard_join_hard_rows(docs, empty):
    assert jaccard_join.jaccard_components(docs).count() == len(rows())
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.representatives(docs).where("doc_id IS NULL").count() == 1
    assert jaccard_join.representatives(empty).count() == 0


def words_with(last, n=200):
    return " ".join([f"w{i}" for i in range(n - 1)] + [last])


def test_jaccard_join_of_null_ids(spark):
    texts = [(1, words_with("x")), (None, words_with("y")), (None, "alone in a row of words"), (7, words_with("z")), (None, words_with("y")), (3, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (None, None), (7, 1), (None, 1), (3, 3)], key=str)


def test_representatives_of_repeated_ids(spark):
    texts = [(1, words_with("x")), (1, "another text of the same id"), (2, words_with("y")), (2, "a text that only two has"), (4, "twice the same row"), (4, "twice the same row"), (None, words_with("z")), (6, ""), (6, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.representatives(df, 3, 90).collect()), key=str)
    assert got == sorted([texts[0], texts[1], texts[3], texts[4], texts[7], texts[8]], key=str)


def edits(seed, count, length, most):
    r = random.Random(seed)
    base = [f"v{i}" for i in range(length)]
    for i in range(count):
        words = list(base)
        for _ in range(r.randint(0, most)):
            words[r.randrange(length)] = f"n{r.randrange(1000)}"
        yield i, " ".join(words)


@pytest.mark.parametrize(("n", "percent", "most"), [(3, 90, 6), (5, 80, 9)])
def test_jaccard_blocks_of_large_groups(spark, monkeypatch, n, percent, most):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    texts = list(edits(7, 90, 120, most)) + [(100 + i, t + " and more") for i, t in edits(8, 40, 60, most)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, n, percent).collect()} == linked(texts, n, percent)


def test_candidates_of_one_band_stay_few(spark):
    r = random.Random(4)
    shared = [f"s{i}" for i in range(12)]
    texts = [(i, " ".join([r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(20)] + shared)) for i in range(5_000)]
    texts += [(9_000 + i, texts[i][1] + " x") for i in range(50)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    seen = []
    plain = jaccard_join.linked
    jaccard_join.linked = lambda docs, nodes, pairs, *a: seen.append(pairs.count()) or plain(docs, nodes, pairs, *a)
    try:
        got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(df).collect()}
    finally:
        jaccard_join.linked = plain
    assert all(got[9_000 + i] == i for i in range(50)) and max(seen) < 10_000


def test_parity_sketches_bound_differences():
    r = np.random.default_rng(6)
    for size, percent in [(s, p) for s in (1, 3, 40, 300, 3000) for p in (80, 90)]:
        a = np.unique(r.choice(1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 10 :], r.choice(1 << 62, size).astype(np.uint64)]))
        both = jaccard_join.sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), percent)
        fold = lambda bits, n: bits if len(bits) == n else fold(bits[: len(bits) // 2] ^ bits[len(bits) // 2 :], n)
        x, y = (np.unpackbits(np.frombuffer(s.as_buffer(), np.uint8)) for s in both)
        narrow = min(len(x), len(y))
        found = jaccard_join.differing_bits(both, np.array([0]), np.array([1]))[0]
        assert found == (fold(x, narrow) != fold(y, narrow)).sum() <= len(np.setxor1d(a, b))


def test_pigeonhole_loses_no_pair():
    r = np.random.default_rng(5)
    for size in (10, 11, 19, 40, 150, 600):
        for percent in (80, 90):
            for _ in range(20):
                a = r.choice(1 << 62, size, replace=False).astype(np.uint64)
                most = (100 - percent) * 2 * size // (100 + percent)
                keep = size - r.integers(0, most // 2 + 1)
                b = np.sort(np.concatenate([a[:keep], r.choice(1 << 62, max(0, most // 2 - (size - keep)), replace=False).astype(np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common):
                    continue
                edges = jaccard_join.band_edges(percent, 2000)
                low, high = sorted((np.sort(a), b), key=len)
                band = np.searchsorted(edges, len(high), side="right") - 1
                upper = int(edges[band + 1]) - 1
                often = lambda x: (jaccard_join.mix(x, 1) % np.uint64(7)).astype(np.int64) * (r_often > 0)  # noqa: E731, B023
                for r_often in (0, 1):
                    sigs = [set(jaccard_join.band_signatures(x, np.zeros(len(x), int), np.array([band]), np.array([upper]), percent, often(x))[0]) for x in (low, high)]
                    need = jaccard_join.promised(len(high), len(np.setxor1d(a, b)), percent)
                    assert len(sigs[0] & sigs[1]) >= need or len(np.setxor1d(a, b)) == 0


def test_template_pages_are_not_compared_with_each_other(spark):
    """Pages of one template that are no links: work follows the pages, not their pairs; those that are copies still meet."""
    rng = random.Random(9)
    base = [f"t{rng.randrange(10**6)}" for _ in range(260)]
    page = lambda: " ".join(w if k % 13 else f"f{rng.randrange(10**9)}" for k, w in enumerate(base))
    for n in (300, 1200):
        texts = [page() for _ in range(n)]
        near = texts[7].split()
        near[100] = "other"
        df = spark.createDataFrame(list(enumerate([*texts, texts[3], " ".join(near)])), "doc_id bigint, text string").repartition(4)
        found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 5, 80).collect()}
        assert {i: c for i, c in found.items() if i != c} == {n: 3, n + 1: 7}
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lists = pages.select("doc_id", jaccard_join.row_name().alias("rid"), word_hashes(ascii_lower(F.col("text"))).alias("_h"))
    schema = "sig bigint, node bigint, doc struct<doc_id: bigint, rid: bigint, size: bigint, sketch: binary>"
    signatures = lists.mapInArrow(jaccard_join.sets_udf(5, 80, jaccard_join.frequent_shingles(lists, 5)), schema).where("doc IS NULL")
    groups = [r.n for r in signatures.groupBy("sig").agg(F.countDistinct("node").alias("n")).collect()]
    assert sum(n * (n - 1) // 2 for n in groups) < 20 * len(texts)


def test_katz(docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in lm_katz.katz_scores(docs).collect()}
    texts = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    one, two = collections.Counter(), collections.Counter()
    for i, w in texts:
        if not held(i):
            one.update(w)
            two.update(zip(["start", *w[:-1]], w, strict=True))
    total, distinct = sum(one.values()), len(one)
    of = lambda c: [sum(c.values()), len(c), *[collections.Counter(c.values())[r] for r in range(1, lm_katz.K + 2)]]
    d1, d2 = lm_katz.discounts(of(one)), lm_katz.discounts(of(two))
    kept = lambda c, d: d[c] * c if c <= lm_katz.K else c - lm_katz.TAIL
    unseen = 1 - sum(kept(c, d1) for c in one.values()) / total
    lower = lambda w: kept(one[w], d1) / total if one[w] else unseen
    context = dict(one) | {"start": one[None]}
    seen, mass = collections.defaultdict(float), collections.defaultdict(float)
    for (a, w), c in two.items():
        seen[a] += kept(c, d2) / context[a]
        mass[a] += lower(w)

    def p(a, w):
        if two[(a, w)]:
            return kept(two[(a, w)], d2) / context[a]
        return lower(w) * ((1 - seen[a]) / (1 - mass[a]) if context.get(a) else 1)

    for a in list(seen)[:5]:
        assert math.isclose(sum(p(a, w) for w in one) + p(a, "never seen"), 1, rel_tol=1e-9)
    for i, w in texts:
        r = got[(i, len(w))]
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        score = sum(math.log10(p(a, x)) for a, x in zip(["start", *w[:-1]], w, strict=True))
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(one[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert lm_katz.katz_scores(empty).count() == 0
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("decimal(12,0)"))
    assert {(r.doc_id, r.n_tokens) for r in lm_katz.katz_scores(ids).collect()} == set(got)


def test_discounts_lie_between_0_and_1():
    for counts in ([0] * 6, [10, 8, 9, 1, 0, 3], [1000, 300, 120, 70, 40, 30], [5, 50, 500, 5, 5, 5]):
        d = lm_katz.discounts([0, 0, *counts])
        assert ((d[1:] > 0) & (d[1:] < 1)).all()


def generalised_jaccard(a, b):
    x, y = collections.Counter(a.encode().split()), collections.Counter(b.encode().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints(docs, empty):
    one = docs.where("doc_id IS NOT NULL AND shard = 'clash'")
    texts = [(r[0], r[1] or "") for r in rows() if r[0] is not None and r[5] == "clash"]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(one).collect()}
    errors, by_text = [], {}
    for (i, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        r, k = got[i], len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        if text.split():
            errors += [r.near_edited - generalised_jaccard(text, edited), r.near_next - generalised_jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.25
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert fingerprints.edited_fingerprints(docs).count() == len(rows())
    alone = fingerprints.edited_fingerprints(docs.where("doc_id = 12")).first()
    assert alone.near_next == 1.0


def test_fingerprint_errors_are_those_of_64_samples(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randrange(9)) for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(df).collect()}
    assert all(len(x.fingerprint) // 8 >= 64 for x in got.values())
    z = []
    for i, text in enumerate(texts):
        after, k = texts[(i + 1) % len(texts)], len(text) // 4
        for near, other in ((got[i].near_edited, text[: len(text) - k] + after[:k]), (got[i].near_next, after)):
            p = generalised_jaccard(text, other)
            z.append((near - p) / math.sqrt(p * (1 - p) / 64))
    assert np.max(np.abs(z)) < 5 and 0.85 < np.std(z) < 1.15 and abs(np.mean(z)) < 0.25


def test_fingerprints_tell_words_beyond_the_count_of_one_term(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "COUNT_BITS", 3)
    monkeypatch.setattr(fingerprints, "TERM_COUNT", 7, raising=False)
    texts = ["a " * 7 + "b", "a " * 50 + "b", "a " * 100 + "b c", "b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sketch = {x.doc_id: x.sketch for x in fingerprints.fingerprint_table(df, ["doc_id"], samples=400).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2), (2, 3)):
        want = generalised_jaccard(texts[i], texts[j])
        assert abs(np.mean([a == b for a, b in zip(sketch[i], sketch[j], strict=True)]) - want) < 5 * math.sqrt(want * (1 - want) / 400)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_secret_scan(spark, docs, empty):
    secrets = [
        (100, "secret: token: abcdefghijk PASSWORD=\"x1234567890\" AKIA" + "A1" * 8 + " é" + "ab12" * 9 + " api_key=short sk-9fJ2kLm4Qx7Rt1Vb8Zw3 x"),
        (101, "token=token=abcdefghij Token = \"zzzzzzzz"),
        (102, "thethethethethethe12thethethe is no secret"),
        (103, None),
        (103, None),
    ]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(secrets, "doc_id bigint, text string"))
    texts = [(r[0], r[1] or "") for r in rows()] + [(i, t or "") for i, t in secrets]
    want = []
    for i, s in texts:
        assign = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(s) if len(m[2]) >= 8]
        access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 16]
        hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 32]
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(assign + access + hexes))
        want.append((i, len(assign), len(access), len(hexes), hashlib.sha256(joined.encode()).hexdigest()))
    got = secret_scan.scan_digests(df)
    assert pairs(got, "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=str)
    random_spans = {r.doc_id: r.spans for r in got.where("n_random > 0").collect()}
    start = secrets[0][1].index("sk-9f")
    assert f"random:{start}:{start + 23}" in random_spans[100] and 102 not in random_spans
    assert secret_scan.scan_digests(empty).count() == 0


def test_redaction_leaves_no_span(spark):
    df = spark.createDataFrame([(1, "a password=abcdefgh1 b", 99), (2, "clean", 5), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(df).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: ("clean", 5), 3: (None, None)}


def test_secret_scan_misses_few_random_strings_among_identifiers(spark):
    r = random.Random(17)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = (base62, base62 + "-_", base62[26:])
    key = lambda i: "".join(r.choice(alphabets[i % 3]) for _ in range((20, 24, 32)[i // 3 % 3]))
    no_digit = lambda: "".join(r.choice(base62[:52]) for _ in range(20))
    words = "get user account profile index table value count report status".split()
    texts = [(i, "text", "-".join(r.choice(words) for _ in range(5)) + "-2") for i in range(9_000)]
    texts += [(10_000 + i, "key", key(i)) for i in range(900)] + [(20_000 + i, "letters", no_digit()) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, kind string, text string").repartition(4)
    found = {x.doc_id for x in secret_scan.scan_digests(df.select("doc_id", "text")).where("n_random > 0").collect()}
    share = lambda kind: np.mean([i in found for i, k, _ in texts if k == kind])
    print("found", {k: share(k) for k in ("text", "key", "letters")})
    assert share("key") > 0.97 and share("letters") > 0.85 and share("text") < 0.1


def test_secret_scan_keeps_what_base_spans_leave_of_a_candidate(spark):
    key = "sk-9fJ2kLm4Qx7Rt1Vb8Zw3"
    text = "é " + key + "/AKIA" + "A1B2" * 4 + "_" + key + " token=abcdefgh"
    spans = secret_scan.scan_digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().spans.split(",")
    at = text.index("AKIA")
    assert spans == [f"random:2:{at}", f"access:{at}:{at + 20}", f"random:{at + 20}:{at + 21 + len(key)}", f"assign:{len(text) - 14}:{len(text)}"]


def test_secret_scan_of_many_matches(spark):
    pieces = ["token=abcdefgh ", "AKIA" + "A1" * 8 + " ", "ab12" * 9 + " ", "sk-9fJ2kLm4Qx7Rt1Vb8Zw3 "]
    text = "é" + "".join(pieces * 25_000)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = secret_scan.scan_digests(df).first()
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", text)]
    joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got.n_random == 25_000
    assert secret_scan.redact(df).first().text == "é" + "[SECRET] " * 100_000


def battery_by_hand(value):
    """The four tests in plain Python."""
    alphabet = next(a for a in secret_scan.ALPHABETS if set(value) <= set(a))
    n, k, x = len(value), len(alphabet), [alphabet.index(c) for c in value]
    tail = lambda z: 1 / (1 + math.exp(1.5976 * (z := max(-8, min(8, z))) + 0.070566 * z**3))
    chi_tail = lambda c, df: tail(((max(c, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    symbols = chi_tail(sum((x.count(i) - n / k) ** 2 / (n / k) for i in range(k)), k - 1)
    kind = lambda c: 0 if c.isdigit() else 1 if c.isupper() else 2
    sizes = collections.Counter(map(kind, alphabet))
    seen = collections.Counter(map(kind, value))
    classes = chi_tail(sum((seen[i] - n * s / k) ** 2 / (n * s / k) for i, s in sizes.items()), len(sizes) - 1)
    high = [2 * v >= k for v in x]
    h, low = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 1 + 2 * h * low / n
    run_p = 2.0 ** (1 - n) if not h or not low else 2 * tail(abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9)))
    mean = sum(x) / n
    variance, covariance = sum((v - mean) ** 2 for v in x), sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False))
    serial = 2 * tail(abs(covariance / variance + 1 / (n - 1)) * math.sqrt(n - 1)) if variance else 0
    return 1 - (1 - max(0, min(1, symbols, classes, run_p, serial))) ** 4


def test_battery_and_thresholds_by_hand(spark):
    r = random.Random(21)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    values = ["".join(r.choice(r.choice([base62, base62[26:], "0123456789abcdef", base62 + "+/"])) for _ in range(r.randrange(20, 90))) for _ in range(150)]
    values += ["".join(r.choice(base62) for _ in range(r.randrange(20, 90))) for _ in range(150)]
    values += ["-".join(r.choice(["user", "index", "table", "value"]) for _ in range(r.randrange(4, 12))) for _ in range(150)] + ["a" * 30, "0123456789abcdef" * 3]
    got = {x.value: x.p for x in secret_scan.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    want = {v: battery_by_hand(v) for v in values}
    assert all(math.isclose(got[v], want[v], rel_tol=1e-6, abs_tol=1e-9) for v in values)
    bands = collections.defaultdict(list)
    for i, v in enumerate(values):
        bands[min(6, int(math.log2(len(v) / 20)))].append(want[v])
    limits = {}
    for b, ps in bands.items():
        for t in secret_scan.THRESHOLDS:
            reported, random_ones = sum(p > t for p in ps), sum(p > 0.2 for p in ps) / 0.8
            limits.setdefault(b, secret_scan.THRESHOLDS[-1])
            if 1 - random_ones * (1 - t) / max(reported, 1) <= secret_scan.FALSE_SHARE:
                limits[b] = t
                break
    rows_ = spark.createDataFrame([(b, float(p)) for b, ps in bands.items() for p in ps], "band int, p double")
    assert {x.band: x.threshold for x in secret_scan.band_thresholds(rows_).collect()} == limits
    spans = secret_scan.scan_digests(spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string"))
    for x in spans.where("n_hex = 0").collect():
        v = values[x.doc_id]
        assert x.n_random == int(want[v] > limits[min(6, int(math.log2(len(v) / 20)))])


def test_p_values_of_random_strings_are_about_uniform(spark):
    r = random.Random(5)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    df = spark.createDataFrame([("".join(r.choice(base62) for _ in range(40)),) for _ in range(4_000)], "value string")
    p = np.array([x.p for x in secret_scan.battery(df).select("p").collect()])
    assert all(abs((p > t).mean() - (1 - t)) < 0.05 for t in (0.01, 0.05, 0.2))


def test_randomness_battery_tells_random_from_text(spark):
    r = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    values = [("random", "".join(r.choice(alphabet) for _ in range(40))) for _ in range(200)]
    values += [("text", "".join(r.choice(["the", "and", "ing", "er", "on", "2"]) for _ in range(16))[:40]) for _ in range(200)]
    got = secret_scan.battery(spark.createDataFrame(values, "kind string, value string")).groupBy("kind").agg(F.avg((F.col("p") > 0.05).cast("double")).alias("share")).collect()
    share = {x.kind: x.share for x in got}
    assert share["random"] > 0.9 and share["text"] < 0.1


def water(sizes, weights, cap):
    total, names, target = sum(sizes.values()), list(sizes), {}
    open_, rest = set(names), float(total)
    while open_:
        level = rest / sum(weights[n] for n in open_)
        full = {n for n in open_ if level * weights[n] > cap * sizes[n]}
        if not full:
            return target | {n: level * weights[n] for n in open_}
        for n in full:
            target[n] = cap * sizes[n]
            rest -= cap * sizes[n]
        open_ -= full
    return target


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted((n for n in sizes if n is not None)) + [None]
    want = water(sizes, dict(zip(names, [5, 2, 1, 5], strict=True)), 3)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    largest = max(len((r[1] or "").split()) for r in rows())
    assert len(got) == len(rows()) and all(abs(taken[n] - want[n]) <= largest for n in names)
    again = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r["size"], r.taken) for r in got)
    assert mixing.mix(empty).count() == 0
    assert all(r.copies == 0 for r in got if not r["size"])
    times = collections.Counter()
    for r in got:
        times[(r.doc_id, r.row_key)] += r.copies
    written_out = collections.Counter((r.doc_id, r.k) for r in mixing.mixed(docs).select("doc_id", mixing.row_key().alias("k")).collect())
    assert written_out == +times


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 1, 1)])
def test_mixing_selects_by_key(spark, weights):
    """Which documents are taken once more than others: those whose keys come first, up to the rest of the target."""
    r = random.Random(12)
    texts = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.choice([0, 1, 3, 30, 80]))), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, source string").repartition(3)
    got = {x.doc_id: x for x in mixing.mix(df, weights).collect()}
    for name in ("s0", "s1", "s2"):
        own = [(i, t.split()) for i, t, s in texts if s == name]
        total, target = sum(len(w) for _, w in own), got[own[0][0]].target
        keys = {}
        for i, w in own:
            digest = hashlib.md5((" ".join(w)).encode()).hexdigest()
            u = (int(hashlib.md5(f"mix:{i}:{digest}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
            keys[i] = -math.log(u) / (0.1 + 0.9 * len(set(w)) / len(w) if w else 0.1)
        epochs = 3 if target >= 3 * total else int(target // total)
        rest, before = target - epochs * total, 0
        for i, w in sorted(own, key=lambda x: keys[x[0]]):
            want = (epochs + (before + len(w) / 2 <= rest)) if w else 0
            assert got[i].copies == want
            before += len(w)


def test_sharding(docs, empty):
    got = sharding.hilbert_shards(docs).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows()) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(counts) for i in range(counts[s])]
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows())
    assert sharding.hilbert_shards(empty).count() == 0
    names = [sorted({r[c] for r in rows()}, key=lambda v: (v is not None, v)) for c in (3, 2)]
    cell = lambda r: [names[k].index(r[c]) * 256 // len(names[k]) for k, c in enumerate((3, 2))] + [min(255, int(math.log2(len((r[1] or "").encode()) + 1) * 256 / 32))]
    points = np.array([cell(r) for r in rows()])
    index = sharding.hilbert_index([points[:, k] for k in range(3)], 8)
    want = sorted(((int(i), r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())) for i, r in zip(index, rows(), strict=True)))
    placed = [(x.curve_index, x.doc_id is not None, x.doc_id or 0, x.text_crc32) for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert placed == want


def test_written_shards_hold_each_row_once(spark, docs, empty, tmp_path):
    twice = docs.unionByName(docs.where("doc_id = 5"))
    sharding.write_shards(twice, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.groupBy("_shard").count().select("count").collect(), key=str)[0]["count"] >= (len(rows()) + 2) // 8
    same = lambda df: sorted((str(r.asDict()) for r in df.select(*docs.columns).collect()))
    assert same(back) == same(twice)
    sharding.write_shards(empty, str(tmp_path / "none"))


@pytest.mark.parametrize("d", [2, 3])
def test_hilbert_curve_visits_all_cells_by_neighbours(d):
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    index = sharding.hilbert_index([grid[:, i] for i in range(d)], 3)
    path = grid[np.argsort(index)]
    assert sorted(index) == list(range(side**d)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_quality_classifier(spark, docs, empty):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [r.choice(["alpha", "beta", "gamma", "delta", "over", "under", "and"]) for _ in range(80)]
        texts.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), f"host{i % 7}", "p"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame(texts, "doc_id bigint, text string, source string, lang string")
    y = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {x.doc_id: x.kept for x in quality_classifier.quality_scores(df, y).collect()}
    held = [i for i in range(400) if i % 2 and i % 5]
    assert sum(got[i] == (i % 4 != 0) for i in held) / len(held) > 0.98
    assert quality_classifier.keep_quality(df, y).count() == sum(got.values())
    assert quality_classifier.quality_scores(docs, y).count() == len(rows())
    assert quality_classifier.quality_scores(empty, y).count() == 0
    nothing = quality_classifier.quality_scores(docs, y.where("false"))
    assert nothing.where("NOT kept").count() == 0


def test_sample_stays_within_its_bound(spark, monkeypatch):
    """A doc_id that fills a third of the labelled rows is one row of the sample, and the sample is about as large as its bound."""
    fitted = []
    fit = quality_classifier.fit_logistic
    monkeypatch.setattr(quality_classifier, "fit_logistic", lambda x, y: fitted.append(len(y)) or fit(x, y))
    good, bad = "a quiet text of {} plain words", "BUY {} !!! $$$ ### now now now"
    rows = [(i, (good if i % 2 else bad).format(i)) for i in range(2_000)] + [(7, good.format(7))] * 1_000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(2_000)], "doc_id bigint, quality int")
    for bound, least, most in ((10_000, 2_000, 2_000), (400, 300, 500)):
        fitted.clear()
        kept = {r.doc_id for r in quality_classifier.quality_scores(docs, labels, bound=bound).where("kept").collect()}
        assert least <= fitted[0] <= most and kept == set(range(1, 2_000, 2))


def test_sparse_sites_are_shrunk(spark):
    rows = [(i, "good words in a row here " * 5, "big", "p") for i in range(50)] + [(99, "good words in a row here " * 5, "small", "p")]
    rows += [(200 + i, "BAD!! " * 20, "worse", "p") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    y = spark.createDataFrame([(i, 1) for i in range(0, 50, 2)] + [(200 + i, 0) for i in range(0, 50, 2)], "doc_id bigint, quality int")
    got = {x.doc_id: x.path_posterior for x in quality_classifier.quality_scores(df, y).collect()}
    assert got[0] > got[99] > got[200]
