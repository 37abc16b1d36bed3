"""What steps leave on disk, and phrase matching without building every run of words."""

import os
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from phrasegraph.operators import phrases as P
from phrasegraph.plans.durable import durable, ensure_checkpoint_dir, settled


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return manager.getAllBlocks().mkString(" ").count("shuffle_")


def step_folders(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("phrasegraph-step-")}


def corpus(spark, n=60):
    dice = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    rows = [(k // 2 if k % 9 else None, " ".join(dice.choice(words) for _ in range(dice.randint(0, 25)))) for k in range(n)]
    rows += [(3, None), (None, None), (4, ""), (5, "New York, new york NEW YORK")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_a_step_leaves_no_shuffle_files(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    start = shuffle_files(spark)
    step = durable(spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 5_000).alias("k")).agg(F.collect_list("id").alias("l")))
    for _ in range(40):
        if shuffle_files(spark) <= start:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= start
    assert step.count() == 5_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_collocations_leave_their_last_rows_only(spark):
    _, docs = corpus(spark)
    rows = P.word_rows(docs)
    before = step_folders(spark)
    merged = P.collocation_rows(rows, count_min=3, pmi_min=0.0)
    assert len(step_folders(spark) - before) == 1
    assert merged.filter(F.exists("words", lambda w: F.contains(w, F.lit("_")))).count() > 0


def test_mined_phrases_count_the_noun_spans_once(spark):
    _, docs = corpus(spark)
    before = step_folders(spark)
    phrases, postings = P.mine_phrases(docs, min_doc_count=2)
    # Left are both sides, their table and what its joins read.
    assert len(step_folders(spark) - before) <= 7
    assert phrases.count() >= 0 and postings.count() >= 0


def test_runs_of_words_are_built_for_known_phrases_only(spark):
    rows, docs = corpus(spark)
    wanted = ["w1 w2", "w3 w4 w5", "new york", "w0", "w7 w7", "not there at all", "W1 w2", "w1  w2", ""]
    found = durable(spark.createDataFrame([(p, 1) for p in [*wanted, "w1 w2", None]], "phrase string, n int").dropna())
    lengths = [1, 2, 3, 4]
    every, some = P.ngrams(docs, lengths), P.ngrams(docs, lengths, among=found, n_among=found.count())
    want = Counter()
    for doc, text in rows:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        want.update((doc, " ".join(words[i : i + n])) for n in lengths for i in range(len(words) - n + 1))

    def counted(frame):
        return {(r[0], r[1]): r[2] for r in frame.groupBy("doc_id", "phrase").agg(F.sum("n")).collect()}

    assert counted(every) == dict(want)
    got = counted(some)
    assert {k: n for k, n in got.items() if k[1] in wanted} == {k: n for k, n in want.items() if k[1] in wanted}
    assert len(got) < len(want) / 4

    matched = P.phrase_matches(found.select("phrase", "n"), docs, min_doc_count=1)
    assert {(r["doc_id"], r["phrase"]): r["n"] for r in matched.collect()} == {k: n for k, n in want.items() if k[1] in wanted}


def test_settled_result_outlives_its_steps(spark):
    before = step_folders(spark)
    out = settled(spark, lambda: durable(spark.range(5)).filter("id > 1"))
    assert len(step_folders(spark) - before) == 1 and out.count() == 3


def test_inner_matches_against_text_search(spark):
    dice = random.Random(5)
    made = lambda least, most, longest: " ".join("".join(dice.choice("ab") for _ in range(dice.randint(1, longest))) for _ in range(dice.randint(least, most)))
    rows = [(k // 2 if k % 7 else None, made(0, 20, 4)) for k in range(80)] + [(1, None), (2, "é éa aé üb"), (3, "aa aa aa aa aa aa"), (4, "A-b a_b a.b")]
    wanted = {made(1, 4, 3) for _ in range(150)} | {"aa aa", "aa aa aa", "é aé", " a b", "a ", "a  b", "b a ", ""}
    want = Counter()
    for doc, text in rows:
        joined = " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
        want.update({(doc, p): joined.count(p) for p in wanted if " " in p and p in joined})
    before = step_folders(spark)
    phrases = spark.createDataFrame([(p,) for p in [*wanted, None, "aa aa"]], "phrase string")
    got = P.substring_matches(phrases, spark.createDataFrame(rows, "doc_id long, text string"), min_doc_count=1)
    # The phrases, the matches and what the last join reads: neither words nor their places are written.
    assert len(step_folders(spark) - before) <= 3
    assert {(r["doc_id"], r["phrase"]): r["n"] for r in got.collect()} == dict(want)


def test_only_possible_pairs_move(spark):
    pairs = spark.createDataFrame([(k, f"a{k}", f"b{k % 7}") for k in range(3_000)], "_block long, a string, b string")
    found = spark.createDataFrame([("a5", "b5", 9), ("a9", "b2", 7)], "a string, b string, n_ab long")
    some = {(r["a"], r["b"]) for r in P._possible_pairs(pairs, found, 2).collect()}
    assert {("a5", "b5"), ("a9", "b2")} <= some and len(some) < 300
