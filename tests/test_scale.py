"""Work that must not grow faster than the input: results against brute force, and what is moved for them."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from phrasegraph.operators import graph as G
from phrasegraph.operators import phrases as P
from phrasegraph.operators import sampling as H


def test_hyphen_spans_by_document_equal_the_joins_of_tokens(spark):
    docs = spark.createDataFrame(
        [(1, "a -b c- d"), (1, "x - y"), (2, "- -"), (3, None), (None, "p -q"), (4, "-"), (5, "two-way -"), (6, "")], "doc_id long, text string"
    )
    tokens, whole = P.marked_tokens(docs), P.marked_tokens(docs, by_document=True)
    dash, word = tokens.filter("token = '-'").select("doc_id", "pos"), tokens.filter("token <> '-'")
    sides = [
        dash.join(word.withColumn("pos", F.col("pos") + move), ["doc_id", "pos"]).select(
            "doc_id", (F.col("pos") - max(move, 0)).alias("start"), F.lit(2).alias("length"), F.concat(*phrase).alias("phrase")
        )
        for move, phrase in ((-1, (F.lit("-"), "token")), (1, ("token", F.lit("-"))))
    ]
    spans = sides[0].unionByName(sides[1])
    assert sorted(map(tuple, P.hyphen_spans(whole).collect())) == sorted(map(tuple, spans.collect()))
    # Spans of a document without text or without an id stay as they are.
    extra = spark.createDataFrame([(9, 1, 2, "-z"), (None, 1, 2, "z-"), (1, 1, 2, "plain")], "doc_id long, start int, length int, phrase string")
    spans = spans.unionByName(extra)
    order = {"key": lambda r: tuple(map(str, r))}
    by_rows = sorted(map(tuple, P.repair_hyphen_spans(spans, tokens).collect()), **order)
    assert sorted(map(tuple, P.repair_hyphen_spans(spans, whole).collect()), **order) == by_rows


def test_hyphen_spans_move_no_single_token(spark):
    docs = spark.createDataFrame([(i, "a -b c") for i in range(4)], "doc_id long, text string")
    whole = P.marked_tokens(docs, by_document=True)
    plan = P.repair_hyphen_spans(P.hyphen_spans(whole), whole)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Join") == 1


def test_frequent_pairs_are_counted_as_met_and_not_looked_up(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a pair found must not be probed in all documents of a phrase")

    monkeypatch.setattr(G, "shared_documents", never)
    rng = random.Random(3)
    # Narrow documents, a wide one with many rare phrases (cut) and two wide ones that are not.
    docs = {d: {f"k{rng.randrange(12)}" for _ in range(rng.randrange(1, 5))} for d in range(40)}
    docs |= {100: {f"k{i}" for i in range(40)}, 101: {f"k{i}" for i in range(30)}, 102: {f"k{i}" for i in range(25, 40)}, 103: {f"k{i}" for i in range(9)}}
    shared = {}
    for held in docs.values():
        for pair in combinations(sorted(held), 2):
            shared[pair] = shared.get(pair, 0) + 1
    table = spark.createDataFrame([(k, d) for d, held in docs.items() for k in held], "kid string, doc_id long")
    for least, block in ((2, 6), (3, 6)):
        got = [tuple(r) for r in G.frequent_cooccurrence(table, least, block_rows=block).select("id1", "id2", "shared").collect()]
        assert sorted(got) == sorted((*p, n) for p, n in shared.items() if n >= least)


def test_shared_documents_of_many_pairs_are_counted_by_document(spark, monkeypatch):
    counted = []
    plain = G.cooccurrence
    monkeypatch.setattr(G, "cooccurrence", lambda *a, **k: counted.append(1) or plain(*a, **k))
    rows = [(k, d) for k in range(1, 6) for d in range(100 * k, 100 * k + 30)] + [(1, 900), (2, 900), (3, 900), (2, 901), (3, 901), (4, None), (5, None)]
    table = spark.createDataFrame(rows + [(9, 900)], "kid long, doc_id long")
    # Every pair, one the other way round, one twice, one of a phrase with itself, two with strangers.
    pairs = [*combinations(range(1, 6), 2), (3, 1), (1, 2), (4, 4), (1, 77), (None, 2)]
    got = G.shared_documents(spark.createDataFrame(pairs, "id1 long, id2 long"), table).collect()
    docs = {k: {d for x, d in rows if x == k and d is not None} for k in range(1, 6)}
    want = [(a, b, len(docs.get(a, set()) & docs.get(b, set()))) for a, b in pairs]
    order = {"key": lambda r: tuple(map(str, r))}
    assert sorted(map(tuple, got), **order) == sorted(want, **order)
    assert counted, "30 documents a phrase must not be expanded for each pair"


def test_pairs_without_vectors_are_dropped_before_used_pairs(spark, monkeypatch):
    seen = []
    plain = H.exclude_used
    monkeypatch.setattr(H, "exclude_used", lambda pairs, used: seen.append(pairs.count()) or plain(pairs, used))
    cooc = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 9, 5), (8, 9, 5)], "id1 long, id2 long, shared long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vec array<double>")
    used = spark.createDataFrame([("2||3",)], "pair string")
    got = H.sample_cooccurring(cooc, vectors, 10, 1, 0.9, 42, used).select("id1", "id2").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3)] and seen == [3]
