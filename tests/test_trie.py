"""Longest-match tokenization against a walk by hand."""

import random
import time
import unicodedata

import numpy as np
import pyarrow as pa

from lexispark.functions.profiles import JA
from lexispark.operators import tokens as K
from lexispark.operators import trie


def by_hand(text, forms):
    most = max(map(len, forms), default=1)
    out, at = [], 0
    while at < len(text or ""):
        n = next((n for n in range(min(most, len(text) - at), 1, -1) if text[at : at + n] in forms), 1)
        surface = text[at : at + n]
        at += n
        if not all(9 <= ord(c) <= 13 or unicodedata.category(c).startswith("Z") for c in surface):
            out.append((len(out), surface, forms.get(surface, surface)))
    return out


def random_words(rng, n, letters):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)}


def rows_of(spark, texts, forms):
    content = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "content_id bigint, text string, tokens string, found string")
    lexicon = spark.createDataFrame([(w, f) for w, f in forms.items()], "word string, base_form string")
    got = K.tokenize(content, JA, "lexicon", lexicon).collect()
    return sorted((r.content_id, r.pos, r.surface, r.base_form) for r in got)


def sample(seed):
    rng = random.Random(seed)
    forms = {w: w.upper() if rng.random() < 0.5 else w for w in random_words(rng, 3000, "abcあ日😀é")} | {"a b": "a_b", "  ": "blank", "日本語": "日本語", "日本": "日本"}
    texts = [None, "", "   \n", "a b", "a  b", "日本語日本", "ab" * 4000, "\U0001f469x" * 5]
    texts += ["".join(rng.choice("abcあ日😀é 　\n.") for _ in range(rng.randint(1, 300))) for _ in range(120)]
    return texts, forms


def test_longest_matches(spark):
    texts, forms = sample(1)
    assert rows_of(spark, texts, forms) == sorted((i, *t) for i, text in enumerate(texts) for t in by_hand(text, forms))


def test_a_lexicon_beyond_the_bound_gives_the_same_tokens(spark, monkeypatch):
    texts, forms = sample(2)
    monkeypatch.setattr(trie, "LETTERS", 4_000)
    texts += [texts[-1], texts[5]]
    assert rows_of(spark, texts, forms) == sorted((i, *t) for i, text in enumerate(texts) for t in by_hand(text, forms))


def test_one_least_base_form_for_repeated_words_and_none_for_short_ones(spark):
    content = spark.createDataFrame([(1, "走った")], "content_id int, text string")
    lexicon = spark.createDataFrame([("走った", "走る"), ("走った", "奔る"), ("走", "x"), (None, "y"), ("た", None)], "word string, base_form string")
    assert [(r.surface, r.base_form) for r in K.tokenize(content, JA, "lexicon", lexicon).collect()] == [("走った", min("走る", "奔る"))]
    empty = K.tokenize(content, JA, "lexicon", lexicon.limit(0)).orderBy("pos").collect()
    assert [r.surface for r in empty] == ["走", "っ", "た"]


def test_many_words_cost_no_more_time():
    rng = random.Random(3)
    words = sorted(random_words(rng, 320_000, "abcdefghijklmnop"))
    words = rng.sample(words, 200_000)
    assert len(words) == 200_000
    text = "".join(rng.choice(words) + rng.choice(["", " ", "x"]) for _ in range(60_000))
    points, starts = trie.code_points(pa.array([text]))
    took = {}
    for n in (2_000, 200_000):
        some = pa.array(words if n == 200_000 else rng.sample(words, n))
        made = trie.build(some, some)
        took[n] = min(timed(lambda: trie.walk(trie.longest(made, points)[0], starts)) for _ in range(3))  # noqa: B023
    assert took[200_000] < 8 * took[2_000] and took[200_000] < 10
    made = trie.build(pa.array(words), pa.array(words))
    length = trie.longest(made, points)[0]
    known = set(words)
    for at in rng.sample(range(len(text)), 2_000):
        assert length[at] == max((n for n in range(2, 10) if text[at : at + n] in known), default=0)
    assert np.count_nonzero(length) > len(text) / 20


def timed(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_what_is_found_at_a_place_is_found_in_one_shard(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lexispark.operators import trie

    monkeypatch.setattr(trie, "LETTERS", 8)
    passes = []
    keep = trie.staged
    monkeypatch.setattr(trie, "staged", lambda df, name: passes.append(keep(df, name)) or passes[-1] if name == "matches" else keep(df, name))
    words = spark.createDataFrame([(w,) for w in ("ab", "abc", "abcd", "abcde", "bc", "bcd", "cd")], "word string")
    content = spark.createDataFrame([(1, "abcdeabc bcd"), (2, "")], "content_id bigint, text string")
    lists = {r.content_id: [t.surface for t in r.tokens] for r in trie.lexicon_lists(content, F.col("text"), words).collect()}
    assert lists == {1: ["abcde", "abc", "bcd"], 2: []}
    places = [(r._row, m["at"]) for p in passes for r in p.collect() for m in r.found]
    assert len(passes) > 1 and len(places) == len(set(places))
