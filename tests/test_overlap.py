"""Pages of two versions that meet in cells, against plain comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirecheck.functions import overlap as V
from quirecheck.operators import compare as C
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def plain(a, b, slack):
    """(doc, i, j, band) of (doc, number, text) rows that match."""
    found = set()
    for doc in {d for d, _, _ in a} & {d for d, _, _ in b}:
        left, right = ([(n, set(t.split()) or {""}) for d, n, t in side if d == doc] for side in (a, b))
        band = abs(len(left) - len(right)) + slack
        found |= {(doc, i, j, band) for i, x in left for j, y in right if abs(i - j) <= band and len(x & y) / len(x | y) >= 0.6}
    return found


def versions(seed):
    rng = np.random.default_rng(seed)
    a, b = [], []
    for doc, (n, m) in enumerate([(0, 3), (4, 0), (1, 1), (30, 31), (9, 40), (60, 60), (70, 64), (5, 5)]):
        for side, count in ((a, n), (b, m)):
            side += [(doc, k + 1, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 6)))) for k in range(count)]
    return a, b


@pytest.mark.parametrize("pages, wide, words, step", [(256, 500, 1 << 18, 1 << 20), (8, 500, 7, 5), (8, 12, 50, 100), (0, 0, 1, 1)])
def test_cells_equal_plain_comparison(spark, monkeypatch, pages, wide, words, step):
    """Whole pairs in one cell, cells along the diagonal, and the join for wide bands give the same matches."""
    for name, value in (("PAGES", pages), ("WIDE", wide), ("WORDS", words)):
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(V, "STEP", step)
    a, b = versions(5)
    frames = [spark.createDataFrame(rows, "doc_id long, page_no long, text string") for rows in (a, b)]
    for slack in (1, 6):
        found = [tuple(r) for r in C.page_matches(*frames, slack=slack).select("doc_id", "i", "j", "band").collect()]
        assert len(found) == len(set(found)) and set(found) == plain(a, b, slack)


def test_pages_without_text_or_number_match_nothing(spark):
    rows = [(1, 1, None), (1, 2, " "), (1, None, "x"), (None, 1, "x"), (1, 3, "x")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    assert {(r.doc_id, r.i, r.j) for r in C.page_matches(pages, pages).collect()} == {(1, 2, 2), (1, 3, 3)}


def test_pages_of_a_pair_are_not_dealt_by_word(spark):
    """Before, every page was a row for each of its rarer words, which were shuffled and met by a join."""
    pages = spark.createDataFrame([(1, 1, "some words of a page")], "doc_id long, page_no long, text string")
    plan = C.page_matches(pages, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "meet" not in plan and "array_intersect" not in plan


def test_words_of_equal_pages_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(C, "list_distance", lambda a, b: F.when(a.isNotNull(), F.lit(1)))
    pairs = spark.createDataFrame([("a b", "a b"), ("", ""), ("a b", "a c"), ("a", None)], "text_a string, text_b string")
    assert [r.similarity for r in C.with_word_similarity(pairs).collect()] == [1.0, 1.0, 0.5, None]
