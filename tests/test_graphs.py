"""Components, near duplicates and co-occurrence against brute force on small fixtures."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from phrasegraph.operators import graph as G
from phrasegraph.operators import near_duplicates as ND
from phrasegraph.operators import similarity as S
from phrasegraph.operators.tokens import term_counts
from phrasegraph.plans import skew


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = random.Random(7)
    if kind == "random":
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    elif kind == "chain":
        edges = [(i, i + 1) for i in range(60)]
    else:
        edges = [(500, i) for i in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    got = G.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == brute_components(edges)


def test_components_without_edges(spark):
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    base = rng.choices(words, k=90)
    for i in range(60):  # a third of the corpus and more: near copies of one text
        near = list(base)
        near[i % 90] = f"x{i}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + ["", "..."]
    return list(enumerate(texts))


def brute_pairs(rows, threshold):
    bags = {}
    for i, text in rows:
        words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
        if words:
            bags[i] = Counter(words)
    out = set()
    for a, b in itertools.combinations(sorted(bags), 2):
        x, y = bags[a], bags[b]
        dot = sum(x[w] * y[w] for w in x)
        if dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) > threshold:
            out.add((a, b))
    return out


@pytest.mark.parametrize("block_rows", [7, 512])
@pytest.mark.parametrize("threshold", [0.5, 0.975, 0.985])
def test_dedup_matches_all_pairs(spark, block_rows, threshold):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comp = brute_components(brute_pairs(rows, threshold))
    want = {i for i, _ in rows if comp.get(i, i) == i}
    got = ND.deduplicate(docs, threshold=threshold, block_rows=block_rows).collect()
    assert {r["doc_id"] for r in got} == want
    assert sum(r["n_merged"] for r in got) == len(rows)


def test_sparse_pairs_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = ND.distinct_bags(docs, ND.signatures(docs))
    kept = {r["doc_id"] for r in reps.collect()}
    vectors = term_counts(reps).withColumnRenamed("doc_id", "id")
    for threshold in (0.3, 0.98):
        got = {(r["id1"], r["id2"]) for r in ND.sparse_similar_pairs(vectors, threshold, 7).collect()}
        assert got == {p for p in brute_pairs(rows, threshold) if set(p) <= kept}


def test_chain_of_near_duplicates_keeps_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "id1 string, id2 string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    kept = G.survivors(docs, G.connected_components(edges, "id1", "id2"))
    assert sorted(r["doc_id"] for r in kept.collect()) == ["a", "d"]


def test_cooccurrence_blocks(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(40), 0 if rng.random() < 0.4 else rng.randrange(20)) for _ in range(400)})
    inc = spark.createDataFrame(rows, "kid long, doc_id long")
    want = Counter()
    for d in {d for _, d in rows}:
        want.update(itertools.combinations(sorted(k for k, x in rows if x == d), 2))
    got = {(r["id1"], r["id2"]): r["shared"] for r in G.cooccurrence(inc, block_rows=5).collect()}
    assert got == dict(want)
    pairs = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "id1 long, id2 long")
    shared = {(r["id1"], r["id2"]): r["shared"] for r in G.shared_documents(pairs, inc).collect()}
    assert {p: n for p, n in shared.items() if n} == dict(want)


def test_lookup_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_SHARE", 2)
    big = spark.createDataFrame([(i % 9 if i < 50 else 0, i) for i in range(90)], "k long, v long")
    dim = big.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "k * 10 as x", "n")
    got = skew.lookup(big, dim, ["k"], "n").collect()
    assert sorted((r["k"], r["v"], r["x"]) for r in got) == sorted(
        (i % 9 if i < 50 else 0, i, (i % 9 if i < 50 else 0) * 10) for i in range(90)
    )


def random_vectors(n=90, d=8):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    x[40:70] = x[40] + rng.normal(scale=0.01, size=(30, d))
    return x


def test_blocked_similarity(spark):
    x = random_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, vec array<double>")
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if sims[i, j] > 0.6}
    assert {(r["id1"], r["id2"]) for r in S.similar_pairs(df, 0.6, cell_rows=13).collect()} == want
    comp = {r["id"]: r["component"] for r in S.similarity_components(df, 0.6, cell_rows=13).collect()}
    assert comp == brute_components(want)
    near = {}
    for r in S.nearest(df, 4, cell_rows=13).collect():
        near.setdefault(r["id"], {})[r["rank"]] = r["nn"]
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(sims[i, j], 9), j))
        assert [near[i][k] for k in (1, 2, 3, 4)] == order[:4]


def test_full_triangle_needs_opt_in(spark, monkeypatch):
    monkeypatch.setattr(S, "TRIANGLE_IDS", 2)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "id long, vec array<double>")
    with pytest.raises(ValueError):
        S.pairwise_cosine(df)
    assert S.pairwise_cosine(df, allow_large=True).count() == 6


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 0.0])], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in S.normalized(df).collect()}
    assert got[1] == pytest.approx([0.6, 0.8, 0.0], abs=1e-12) and got[2] == [0.0, 0.0, 0.0]


def test_frequent_cooccurrence_against_all_pairs(spark):
    import random
    from itertools import combinations

    from phrasegraph.operators.graph import frequent_cooccurrence

    rng = random.Random(8)
    # One phrase is in nearly every document, one document holds every phrase, some rows are repeated or null.
    rows = [(f"k{min(int(rng.paretovariate(0.6)), 60)}", rng.randrange(80)) for _ in range(700)]
    rows += [("hot", d) for d in range(75)] + [(f"k{i}", 999) for i in range(1, 61)] + [("hot", 3), (None, 3), ("k1", None)]
    docs = {}
    for k, d in rows:
        if k is not None and d is not None:
            docs.setdefault(d, set()).add(k)
    shared = {}
    for held in docs.values():
        for pair in combinations(sorted(held), 2):
            shared[pair] = shared.get(pair, 0) + 1
    table = spark.createDataFrame(rows, "kid string, doc_id long")
    for least in (1, 4):
        got = {(r["id1"], r["id2"]): r["shared"] for r in frequent_cooccurrence(table, least, block_rows=16).collect()}
        assert got == {p: n for p, n in shared.items() if n >= least}
    assert frequent_cooccurrence(table.filter("doc_id < 0"), 2).count() == 0


def test_leaves_follow_their_host(spark, monkeypatch):
    """Stars and pairs need no round at all (they took two); chains and rings between hosts keep their smallest member."""
    from phrasegraph.operators import graph as G

    rounds, star = [], G._large_star
    monkeypatch.setattr(G, "_large_star", lambda links, n: rounds.append(n) or star(links, n))

    def found(rows):
        out = [tuple(r) for r in G.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()]
        assert len(out) == len(dict(out))
        return dict(out)

    stars = [(9, 1), (9, 20), (2, 9), (9, 20), (40, 41), (50, 50), (60, None), (35, 30), (35, 31), (35, 36)]
    assert found(stars) == {**dict.fromkeys((1, 2, 9, 20), 1), 40: 40, 41: 40, **dict.fromkeys((30, 31, 35, 36), 30)}
    assert not rounds
    linked = [(h, 100 + 10 * h + j) for h in range(5, 9) for j in range(4)] + [(5, 6), (7, 6), (8, 3), (8, 2)]
    got = found(linked)
    assert rounds
    assert {v: got[v] for v in (5, 6, 7, 8, 2, 3, 150, 163, 172, 181)} == {5: 5, 6: 5, 7: 5, 8: 2, 2: 2, 3: 2, 150: 5, 163: 5, 172: 5, 181: 2}
