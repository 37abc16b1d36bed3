from pyspark.sql import functions as F

from phrasegraph.functions import phrases as PF
from phrasegraph.functions.stopwords import DETERMINERS
from phrasegraph.functions.text import squish
from phrasegraph.operators import phrases as P
from phrasegraph.plans.durable import durable


def test_phrases_are_normalised_once(spark):
    rows = [(1, "The Old  town"), (1, "old town"), (2, "x"), (2, None), (3, "a-b"), (3, "é ö")]
    spans = durable(spark.createDataFrame(rows, "doc_id long, phrase string"))
    counts = P.phrase_doc_counts(spans)
    assert {tuple(r) for r in counts.collect()} == {("old town", 1, 2), ("a-b", 3, 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    once = spans.select(PF.normalize_phrase(F.col("phrase")).alias("phrase"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == once.count("regexp_replace")


def test_normal_phrases_stay_as_the_rewriting_leaves_them(spark):
    given = ["old town", "the town", "the", "the-old town", "theory of x", " a b", "a b ", "a  b", "a\tb", "a b\n", "a\nb", "A b", "a b", "é a", "", " ", "-", "- -", "this this x", "x the y", "7 up", "where it", "a"]
    rows = spark.createDataFrame([(x,) for x in [*given, None]], "phrase string")
    col = F.col("phrase")
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), rf"^({'|'.join(DETERMINERS)})\s+", "")
    plain = squish(F.regexp_replace(bare, r"[^a-z0-9\- ]", ""))
    for r in rows.select(col, PF.normalize_phrase(col).alias("got"), plain.alias("want")).collect():
        assert r["got"] == r["want"], r
