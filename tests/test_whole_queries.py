"""Registered queries on small tables that hold the cases which the given ones or their SQL may hide, against brute force."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def run(spark, tmp_path):
    def of(name, texts):
        rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        df = entry.queries()[name](spark, str(tmp_path))
        got = [r.asDict() for r in df.collect()]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        text = lambda row: str(sorted((k, str(v)) for k, v in row.items()))
        assert sorted(map(text, got)) == sorted(text(dict(zip(columns, r, strict=True))) for r in want.fetchall())
        return got

    return of


LENGTHS = (3_001, 5_001, 50_000, 50_001)


def test_vocab_extract_batch_takes_texts_up_to_the_limit(run):
    got = {r["content_id"]: r for r in run("vocab_extract_batch", [("word " * 20_000)[: n - 1] + "x" for n in LENGTHS])}
    assert [got[i]["error"] for i in range(4)] == [None, None, None, "too_long"]
    assert all(got[i]["n_words"] >= 1 for i in range(3)) and got[3]["n_words"] is None


def test_validate_text_takes_texts_up_to_the_limit(run):
    got = {r["content_id"]: r["error"] for r in run("validate_text", ["a" * n for n in LENGTHS])}
    assert got == {0: None, 1: None, 2: None, 3: "too_long"}


SPECIAL, GRAMMAR = ("esp.", "rare", "archaic", "obsolete", "old", "dated", "specialized"), ("copula", "auxiliary")


def commonness(gloss):
    return -10 * any(t in gloss for t in SPECIAL) + 3 * any(t in gloss for t in GRAMMAR)


def test_dict_meanings_has_entries_whose_writing_holds_a_term(run):
    words = "gold old especially rarely dated updated copula archaic auxiliary scopulas plainly water stone river".split()
    n = {w: 1 + (i + k) % 4 for k in range(1) for i, w in enumerate(words)}
    n |= {f"{w}{x}": 1 + j for w in ("old", "copula", "mint") for j, x in enumerate(("aa", "bb", "cc", "dd"))}
    got = {r["entry_id"]: r["meanings"] for r in run("dict_meanings", [" ".join(w for w, k in n.items() for _ in range(k))])}
    for w, meanings in got.items():
        senses = [{0: "rare ", 1: "auxiliary "}.get(n[w] % 4, "") + w, "plain " + w]
        assert meanings == "; ".join(sorted(senses, key=lambda g: -commonness(g)))
    assert sum(any(t in w for t in SPECIAL + GRAMMAR) for w in got) >= 10


def test_vocab_merge_keeps_every_existing_row(run):
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in ("la", "me", "ni", "po")]
    got = collections.Counter(r["word"] for r in run("vocab_merge", [" ".join(words)]))
    want = collections.Counter(words) + collections.Counter(f"new {w}" for i, w in enumerate(words) if i % 6 == 0)
    assert got == want


def test_import_content_takes_whole_texts(run):
    texts = ["  " + "a line of words\n" * 20 + " \t\n", "\n" + "x" * 31 + "\t", "short ", "", " \n "]
    got = {r["content_id"]: r["text"] for r in run("import_content", texts)}
    assert got == {f"custom-{i}": t.strip(" \t\n") for i, t in enumerate(texts)}
