"""Groups of words by parts of the texts hold what a query asks for and no more."""

import pytest

import __spark_entry__ as entry
from lexispark.functions.profiles import LATIN
from lexispark.operators import places as P
from lexispark.plans import inputs as I

TEXTS = [(3, "b a é"), (1, "a é a"), (None, "é b"), (2, "")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups_have_what_is_asked(spark):
    for texts in (TEXTS, [*TEXTS, (3, "a c")]):  # ids that don't repeat, and do
        content = spark.createDataFrame(texts, "content_id bigint, text string").coalesce(1)
        whole = P.run_groups(content, LATIN)
        for asked in (("content_ids",), ("content_ids", "ords"), ("content_ids", "frequencies")):
            got = P.run_groups(content, LATIN, asked)
            assert got.columns == ["part", "surface", "n", *asked]
            assert rows(P.ungrouped(got)) == rows(P.ungrouped(whole).select(P.ungrouped(got).columns))
            first = P.run_groups(content, LATIN, asked, first=True)
            assert rows(first) == rows(P.first_places(whole).select(first.columns))


def test_codes_are_sorted_stably(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    for most in (1, 3, 70_000, 2**32):
        numbers = rng.integers(0, most, 5_000)
        assert (P.in_order(numbers) == np.argsort(numbers, kind="stable")).all()


WRITTEN = {
    "unknown_anti": ["content_ids"], "vocab_extract_batch": ["content_ids"], "comprehension_band": ["content_ids"], "rank_content": ["content_ids"],
    "known_impact": ["content_ids"], "lesson_queue": ["content_ids", "ords"], "unknown_meanings": ["content_ids", "ords"], "next_words": ["content_ids", "ords"],
}


@pytest.mark.parametrize("name", WRITTEN)
def test_queries_write_only_the_lists_they_read(spark, monkeypatch, name):
    made = []
    written = I.written
    monkeypatch.setattr(I, "written", lambda df, table: made.append((table, df.columns)) or written(df, table))
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert [columns[3:] for table, columns in made if table == "surfaces"] == [WRITTEN[name]]
