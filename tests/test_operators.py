"""Operators on small Japanese fixtures."""


from lexispark.functions.profiles import JA
from lexispark.operators import content as C
from lexispark.operators import lookup as L
from lexispark.operators import tokens as K
from lexispark.operators import vocab as V

LEX = "entry_id string, entry_pos int, variant_pos int, written string, pronounced string, priorities array<string>, gloss string"


def lexicon(spark):
    rows = [
        ("e1", 0, 0, "食べる", "たべる", ["ichi1"], "to eat"),
        ("e1", 0, 1, "喰べる", "たべる", None, "to eat"),
        ("e2", 1, 0, "水", "みず", ["news2"], "water"),
        ("e3", 0, 0, "生", "なま", None, "raw"),
        ("e4", 1, 0, "生", "せい", ["news1"], "life"),
    ]
    return spark.createDataFrame(rows, LEX)


def words(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "word string")


def test_best_variant(spark):
    best = L.best_variant(L.dict_lookup_exact(words(spark, "食べる", "たべる", "生", "みず", "犬"), lexicon(spark)), JA)
    got = {r.word: (r.entry_id, r.written, r.variant_score) for r in best.collect()}
    assert got["食べる"] == ("e1", "食べる", 1200)
    assert got["たべる"] == ("e1", "食べる", 1080)
    assert got["生"] == ("e4", "生", 1199)
    assert got["みず"] == ("e2", "水", 579)
    assert "犬" not in got


def test_fallback_takes_the_first_stem(spark):
    df = spark.createDataFrame([("食べました", "食べました"), ("水", "水"), ("犬", "犬")], "word string, base_form string")
    assert {r.word: r.key for r in L.dict_lookup_fallback(df, lexicon(spark)).collect()} == {"水": "水"}
    more = lexicon(spark).unionByName(spark.createDataFrame([("e9", 0, 0, "食べ", "たべ", None, "stem")], LEX))
    assert {r.word: r.key for r in L.dict_lookup_fallback(df, more).collect()} == {"水": "水", "食べました": "食べ"}


def test_chain_skips_names_for_complex_words(spark):
    one = lambda *rows: spark.createDataFrame(list(rows), "key string, meaning string")
    chain = L.dict_chain(words(spark, "さくら", "桜"), [one(("さくら", "name"), ("桜", "name")), one(("桜", "cherry"))], JA)
    assert {r.word: (r.meaning, r.tier) for r in chain.collect()} == {"さくら": ("name", 0), "桜": ("cherry", 1)}


def test_compound_merge(spark):
    rows = [(1, i, s, r) for i, (s, r) in enumerate([("お", "prefix"), ("茶", "main"), ("を", "skip"), ("田中", "main"), ("さん", "suffix"), ("猫", "main")])]
    df = spark.createDataFrame(rows, "content_id int, pos int, surface string, role string")
    assert [r.word for r in K.compound_merge(df).orderBy("word_no").collect()] == ["お茶", "田中さん", "猫"]


def test_tokens_from_morphemes(spark):
    rows = [(1, 0, "食べ", ["動詞"], "食べる"), (1, 1, "。", ["補助記号"], "。"), (1, 2, " ", ["空白"], " "), (1, 3, "猫", ["名詞"], "")]
    df = spark.createDataFrame(rows, "content_id int, pos int, surface string, pos_tags array<string>, normalized_form string")
    assert [(r.surface, r.base_form) for r in K.tokens_from_morphemes(df).orderBy("pos").collect()] == [("食べ", "食べる"), ("猫", "猫")]


def test_offsets_and_lines(spark):
    content = spark.createDataFrame([(1, "猫が\n猫と犬"), (2, None)], "content_id int, text string")
    tokens = spark.createDataFrame([(1, 0, "猫"), (1, 1, "猫"), (1, 2, "鳥"), (1, 3, "犬")], "content_id int, pos int, surface string")
    spans = K.token_offsets(content, tokens)
    assert [(r.pos, r.start_idx, r.end_idx) for r in spans.orderBy("pos").collect()] == [(0, 0, 1), (1, 3, 4), (3, 5, 6)]
    assert [(r.pos, r.line_no) for r in K.line_tokens(content, spans).orderBy("pos").collect()] == [(0, 0), (1, 1), (3, 1)]


def test_lexicon_tokens(spark):
    content = spark.createDataFrame([(1, "今日は 天気"), (2, None)], "content_id int, text string")
    got = K.tokenize(content, JA, "lexicon", ["今日", "天気"]).orderBy("pos").collect()
    assert [r.surface for r in got] == ["今日", "は", "天気"]


def test_content_status(spark):
    content = spark.createDataFrame([("a",), ("b",)], "content_id string")
    vocab = spark.createDataFrame([("a", "雨", 30, None), ("a", "水", 40, None)], "content_id string, word string, score int, stage int")
    got = {r.content_id: r for r in V.content_status(content, vocab, words(spark, "水")).collect()}
    assert (got["a"].unknown_count, got["a"].total_count, got["a"].status_score, got["a"].difficulty, got["a"].comprehension) == (1, 2, 50.0, 30, 50)
    assert (got["b"].total_count, got["b"].comprehension) == (0, 0)


def test_known_by_stage(spark):
    content = spark.createDataFrame([("a",)], "content_id string")
    vocab = spark.createDataFrame([("a", "雨", 30, 7), ("a", "水", 40, 6)], "content_id string, word string, score int, stage int")
    got = V.content_status(content, vocab, words(spark)).first()
    assert (got.unknown_count, got.status_score) == (1, 70.0)


def test_known_words_clean(spark):
    assert {r.word for r in V.known_words_clean(words(spark, "水", "", "食べる", None, " 　")).collect()} == {"水", "食べる"}


def test_vocab_merge(spark):
    schema = "content_id string, word string, reading string, meaning string, score int"
    old = spark.createDataFrame([("s", "雨", "あめ", "rain", 10)], schema)
    new = spark.createDataFrame([("s", "雨", None, "heavy rain", 0), ("s", "新しい", "あたらしい", "new", 5)], schema)
    got = {r.word: (r.reading, r.meaning, r.score) for r in C.vocab_merge(old, new).collect()}
    assert got == {"雨": ("あめ", "heavy rain", 0), "新しい": ("あたらしい", "new", 5)}


def test_deduplicate_keeps_one_of_each(spark):
    df = spark.createDataFrame([(1, "video", "x"), (2, "story", "x"), (3, "music", "x"), (4, "story", "y")], "content_id int, type string, text string")
    assert {r.content_id for r in C.deduplicate(df).collect()} == {2, 4}


def test_related_words(spark):
    df = spark.createDataFrame([("水着", 0), ("水", 1), ("着物", 2), ("犬", 3)], "word string, ord int")
    got = {(r.word, r.related) for r in L.related_words(df, JA).collect()}
    assert got == {("水着", "水"), ("水着", "着物"), ("水", "水着"), ("着物", "水着")}


def test_related_words_against_brute_force(spark):
    import itertools

    names = ["".join(x) for x in itertools.product("水火木", "人口山川", "一二")]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, ord int")
    got = {}
    for r in L.related_words(df, JA, limit=4).collect():
        got.setdefault(r.word, []).append((r.n, r.related))
    for w in names:
        want = [v for v in names if v != w and set(v) & set(w)][:4]
        assert [v for _, v in sorted(got[w])] == want


def test_word_override_and_names(spark):
    vocab = spark.createDataFrame([("a", "水", 5, False)], "content_id string, word string, score int, joyo boolean")
    fix = spark.createDataFrame([("水", "x7", "3", " a,, b ")], "word string, score string, grade string, priorities string")
    row = V.word_override(vocab, fix).first()
    assert (row.score, row.joyo, row.priorities) == (0, True, "a,b")
    names = spark.createDataFrame([(0, "たなか", "田中", ["Tanaka"]), (1, "たなか", None, ["Other"]), (2, "ぎふ", "ぎふ", [])], "entry_pos int, kana string, kanji string, meanings array<string>")
    assert {r.key: r.meaning for r in L.names_index(names).collect()} == {"たなか": "Tanaka", "田中": "Tanaka", "ぎふ": "Unknown"}


def test_pos_base_form(spark):
    from lexispark.operators.base_forms import pos_base_form

    cases = [
        ("帰っ", "動詞", "五段-ラ行", "連用形-促音便", "帰る"),
        ("書き", "動詞", "五段-カ行", "連用形-一般", "書く"),
        ("作ろ", "動詞", "五段-ラ行", "意志推量形", "作る"),
        ("食べ", "動詞", "下一段-バ行", "連用形-一般", "食べる"),
        ("出かけ", "動詞", "下一段-カ行", "連用形-一般", "出かける"),
        ("し", "動詞", "サ行変格", "連用形-一般", "する"),
        ("こ", "動詞", "カ行変格", "未然形-一般", "くる"),
        ("まし", "助動詞", "助動詞-マス", "連用形-一般", "ます"),
        ("静か", "形状詞", "", "", "静か"),
        ("猫", "名詞", "", "", "猫"),
    ]
    df = spark.createDataFrame([(s, [t, "", "", "", k, f], w) for s, t, k, f, w in cases], "surface string, pos_tags array<string>, want string")
    got = {r.surface: r.base_form for r in pos_base_form(df).collect()}
    assert got == {c[0]: c[4] for c in cases}
