"""Rank array BPE against the library, vector codes and spelling variants against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexispark.llm import cover_tree_codes, cover_tree_sql, queries, rank_array_bpe, spelling_variants

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
sha = lambda data: hashlib.sha256(data).hexdigest()


# ---- 11


def library_rows(rows):
    library = Tokenizer.from_file(PATH)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        yield doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(decoded.encode())


HARD_TEXTS = [
    None, "", " ", "\n\n \t", "a", "<|endoftext|>", "x <|endoftext|><|endoftext|> y<|endoftext|", "<|endoftext", "don't we'll I'M",
    "日本語のテキスト。", "é́ ß ﬁ \U0001f469‍\U0001f680", "　wide space line", "a" * 300, "lo" * 5000, "ab " * 2000, "0123456789" * 40, "\x00\x01\x7f", "z" * 64, "z" * 65,
]


def test_rank_arrays_equal_the_library_on_hard_texts(spark):
    rng = random.Random(5)
    rows = list(enumerate(HARD_TEXTS + ["".join(rng.choice("abcdefgh tionéß日 \n.,!1") for _ in range(rng.randint(1, 400))) for _ in range(200)]))
    rows += [rows[9], (None, "null id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, _p string, n_tokens int")
    got = [tuple(r) for r in rank_array_bpe.encode_digests(docs, PATH, PATTERN).collect()]
    assert Counter(got) == Counter(library_rows(rows))
    whole = rank_array_bpe.encode_texts(docs, PATH, PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, sha(",".join(map(str, r.ids)).encode()), sha(r.decoded.encode())) for r in whole) == Counter(got)
    assert rank_array_bpe.encode_texts(docs.limit(0), PATH, PATTERN).count() == 0


def test_rank_arrays_and_links_agree(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(1, 64))) for _ in range(500)]
    by_row = rank_array_bpe.encode_pieces(pa.array(words), PATH).to_pylist()
    of_byte = rank_array_bpe.merge_table(PATH)[0]
    assert by_row == [rank_array_bpe.encode_long([int(of_byte[b]) for b in w.encode()], PATH) for w in words]


def test_ids_cut_inside_a_character_decode_like_the_library():
    library = Tokenizer.from_file(PATH)
    ids = library.encode("日本 😀").ids
    for k in range(len(ids) + 1):
        data = rank_array_bpe.decode_ids(pa.array([ids[:k]], pa.list_(pa.int32())), PATH)[0].as_py()
        assert rank_array_bpe.text_of(data).decode() == library.decode(ids[:k], skip_special_tokens=False)


@needs_tables
def test_op11_whole_table(spark):
    rows = [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op11_rank_array_bpe(spark, SF).collect())) == Counter(library_rows(rows))


# ---- 12


def lloyd_by_hand(rows, parts=4, entries=256, rounds=4):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    rows = [(i, [*map(float, v)] + [0.0] * (width - len(v)), label) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = [[math.floor(1024 * min(max(x, -65536.0), 65536.0)) for x in v] for _, v, _ in rows]
    step = width // parts
    cut = lambda p, k: p[k * step : (k + 1) * step]
    books = [[cut(p, k) for p in points[:entries]] for k in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for p in points:
                members[near(cut(p, k), books[k])[1]].append(cut(p, k))
            for j, m in members.items():
                books[k][j] = [sum(column) // len(m) for column in zip(*m, strict=True)]
    found = [[near(cut(p, k), books[k]) for k in range(parts)] for p in points]
    digest = sha(",".join(str(x) for book in books for c in book for x in c).encode())
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(rows, error, strict=True):
        by_label[label] += e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, by_label[label], digest) for (i, _, label), f, e in zip(rows, found, error, strict=True)]


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, codes int"


def hard_vectors(seed, n=700, width=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    draw = lambda: [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)]
    hot = draw()
    rows = [(i, hot if i % 3 == 0 else draw(), rng.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 2), (n + 3, [float("inf")] + [0.0] * (width - 1), None)]
    return [*rows, rows[0], rows[0], (None, draw(), None), (n + 4, [1e30] * width, 4), (n + 5, [0.5], 4), (1, draw(), 9), (n + 6, [], 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_codes_by_hand(spark, seed):
    rows = hard_vectors(seed)
    vectors = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in cover_tree_codes.vector_codes(vectors).collect()]
    assert Counter(got) == Counter(lloyd_by_hand(rows))


def test_few_and_no_vectors(spark):
    few = hard_vectors(3, n=20)
    vectors = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in few], VECTORS)
    assert Counter(map(tuple, cover_tree_codes.vector_codes(vectors).collect())) == Counter(lloyd_by_hand(few))
    assert cover_tree_codes.vector_codes(vectors.limit(0)).count() == 0
    assert cover_tree_codes.vector_codes(vectors.where("embedding IS NULL")).count() == 0


def test_many_labels_are_salted(spark, monkeypatch):
    rows = hard_vectors(4, n=60)
    vectors = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS)
    monkeypatch.setattr(cover_tree_codes, "BROADCAST_ROWS", 1)
    assert Counter(map(tuple, cover_tree_codes.vector_codes(vectors).collect())) == Counter(lloyd_by_hand(rows))


@pytest.mark.parametrize("largest", [50, 10_000_000])
def test_trees_cover_and_take_whole_subtrees(largest):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, largest / 60, (300, 6)) for c in np.linspace(-largest, largest, 5)]).astype(np.int64)
    points[::3] = points[0]
    tree = cover_tree_codes.build_tree(points)
    assert sorted(tree["order"].tolist()) == list(range(len(points)))
    for net, radius, begin, end in zip(tree["net"], tree["radius"], tree["begin"], tree["end"], strict=True):
        below = points[tree["order"][begin:end]] - points[tree["centre"][net]]
        assert np.sqrt((below.astype(float) ** 2).sum(axis=1)).max() <= radius
    book = points[[0, 400, 800, 1400, 5, 0]]
    tree["points_of_net"] = points[tree["centre"]]
    ordered = points[tree["order"]]
    entry, runs, left = cover_tree_codes.assign(ordered, tree, book)
    assert entry.tolist() == ((ordered[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert sum(e - b for b, e, _ in runs) + len(left) == len(points) and len(left) < len(points) / 2


@needs_tables
def test_op12_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert Counter(map(tuple, queries.op12_vector_codes(spark, SF).collect())) == Counter(con.execute(cover_tree_sql.vector_codes_sql()).fetchall())


# ---- 13

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    groups = defaultdict(set)
    for w in words:
        groups[w].add(w)
        for k in range(len(w)):
            groups[w[:k] + w[k + 1 :]].add(w)
            groups[w[:k] + "_" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for g in groups.values():
        for a in g:
            near[a] |= {b for b in g if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 5 * n:
                form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None


def test_spelling_variants_by_hand(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéèàçßÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(25)]
    rows = []
    for w in base:
        rows += [w] * 200
        for _ in range(12):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])
            rows += [v] * rng.choice([5, 6, 30, 40, 41, 200])
            rows += [v[:k] + c + v[k:]] * 7
    rows += ["aaaaaa"] * 6 + ["aaaaaaa"] * 30 + ["aaaaaaaa"] * 150 + ["ÀÉÎõöÜ"] * 9 + ["WORDS×word÷"] * 8 + ["Wörter"] * 5
    rng.shuffle(rows)
    docs = [(i, rng.choice([" ", "-", "1 ", "\n"]).join(rows[i * 40 : (i + 1) * 40])) for i in range(len(rows) // 40 + 1)]
    docs += [(None, None), (None, "nothing " * 6), (3, ""), (docs[0]), (9_000, "word" * 5000)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int")
    got = [tuple(r) for r in spelling_variants.spelling_variants(table).collect()]
    assert Counter(got) == Counter(variants_by_hand(docs)) and any(r[1] != r[2] for r in got if r[1])
    assert spelling_variants.spelling_variants(table.limit(0)).count() == 0


def test_any_number_of_symbols_gives_the_same_pairs(spark, monkeypatch):
    words = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "aabcdef", "abdcef", "zzzzzz", "zzzzzzz", "éabcde", "àabcde", "abcdé×"]
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n bigint")
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    for symbols in (1, 2, 3, 16):
        monkeypatch.setattr(spelling_variants, "SYMBOLS", (symbols, symbols))
        got = [(r.word, r.other) for r in spelling_variants.near_pairs(table).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@needs_tables
def test_op13_whole_table(spark):
    rows = [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_spelling_variants(spark, SF).collect())) == Counter(variants_by_hand(rows))
