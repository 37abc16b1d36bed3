"""Golden rows of the text helpers."""

import pytest
from pyspark.sql import functions as F

from phrasegraph.functions import phrases as P
from phrasegraph.functions import text as T
from phrasegraph.functions.stopwords import stopword_list


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    row = spark.createDataFrame([tuple(values)], schema)
    return row.select(expr(*[F.col(n) for n in names]).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (T.drop_soft_hyphens, "co­operate", "cooperate"),
        (T.join_line_hyphens, "inter-\n national", "international"),
        (T.join_line_hyphens, "19-\n20", "19-\n20"),
        (T.join_line_hyphens, "a-\r\nb-\nc", "abc"),
        (T.join_gap_hyphens, "a-   b", "ab"),
        (T.join_gap_hyphens, "a- b", "a- b"),
        (T.pad_parentheses, "x(y)z", "x ( y ) z"),
        (T.squish, " a  \t b\n", "a b"),
        (T.fold_to_ascii, "Straße ’café’ 中", "Strasse 'cafe' "),
        (T.norm_rater, " ab ", "AB"),
        (T.norm_rater, None, ""),
        (T.norm_rater, "  ef  ", "EF"),
        (T.blank_if_null, None, ""),
        (T.blank_if_null, "  ", "  "),
        (T.spaces_for_hyphens, "a-b", "a b"),
        (P.normalize_phrase, "The Decision-Making process!", "decision-making process"),
        (P.normalize_phrase, "the river", "river"),
        (lambda c: P.trim_stopwords(c, stopword_list()), "of the climate change in", "climate change"),
        (lambda c: P.trim_stopwords(c, stopword_list()), "of the", ""),
    ],
)
def test_expression(spark, fn, given, want):
    assert one(spark, fn, given) == want


def test_first_boilerplate_match_only(spark):
    assert one(spark, lambda c: T.strip_boilerplate(c, ["ab+", "zz"]), "x abb y ab") == "x   y ab"


@pytest.mark.parametrize(
    "text, phrase, want",
    [
        ("Cats, dogs, and DOGS.", "dogs", "Cats, <mark>dogs</mark>, and <mark>DOGS</mark>."),
        ("We teach C++ and not C+.", "C++", "We teach <mark>C++</mark> and not C+."),
        ("hello", "", "hello"),
        ("hello", None, "hello"),
        (None, "hi", None),
    ],
)
def test_highlight(spark, text, phrase, want):
    assert one(spark, T.highlight, text, phrase) == want


def test_clean_text_keeps_order_of_steps(spark):
    raw = "Café (inter-\n national)\r\nTHE END. More"
    assert one(spark, lambda c: T.clean_text(c, ["THE END\\."]), raw) == "Cafe ( international ) More"


def test_phrase_words(spark):
    assert one(spark, lambda c: P.phrase_words(c), "decision-making process") == 3


def test_substring_matches_against_text_search(spark):
    import random

    from phrasegraph.operators.phrases import substring_matches

    rng = random.Random(5)
    pool = ["a", "ab", "ba", "aba", "b", "cab", "abc", "bab"]
    docs = [(i if i else None, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    docs += [(39, "ab ab ab"), (40, None), (41, "")]
    phrases = ["a b", "a a", "ab ab", "b a b", "a ba a", "ba b", "b", "zz a", "abc a ba cab"]
    want = {}
    for i, text in docs:
        for p in phrases:
            n = (text or "").count(p)
            if " " in p and n:
                want[p, i] = want.get((p, i), 0) + n
    got = substring_matches(
        spark.createDataFrame([(p, 1) for p in [*phrases, phrases[0]]], "phrase string, n long"),
        spark.createDataFrame(docs, "doc_id long, text string"),
        min_doc_count=1,
    )
    assert {(r["phrase"], r["doc_id"]): r["n"] for r in got.collect()} == want
    none = spark.createDataFrame([], "phrase string, n long")
    assert substring_matches(none, spark.createDataFrame(docs, "doc_id long, text string")).count() == 0
