"""Invariants of the fold split."""

import random

import pytest

from phrasegraph.operators import folds as FO
from phrasegraph.operators.communities import communities, modularity
from phrasegraph.operators.graph import connected_components


def test_fill_shares():
    assert FO.fill_shares([0, 0, 3], 4) == [2, 2, 0]
    assert FO.fill_shares([1, 2, 3], 9) == [4, 3, 2]


def greedy_heaviest(weights, k):
    loads = [0] * k
    for w in sorted(weights, reverse=True):
        loads[loads.index(min(loads))] += w
    return max(loads)


def test_split_without_leaks(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for _ in range(rng.randrange(1, 12)):
            rows.append((f"h{c}", f"n{c}_{rng.randrange(20)}", rng.random()))
    pairs = spark.createDataFrame(rows, "kw1 string, kw2 string, value double")
    out = FO.split(pairs, 5)
    fold = {r["keyword"]: r["fold"] for r in out["keywords"].collect()}
    kept = out["pairs"].collect()
    assert all(fold[r["kw1"]] == fold[r["kw2"]] == r["fold"] for r in kept)
    assert len(kept) == 2 * len(set(rows))
    blocks = out["blocks"].collect()
    weights = [r["weight"] for r in blocks]
    loads = [r["weight"] for r in out["summary"].orderBy("fold").collect()]
    assert sum(loads) == sum(weights) == len(set(rows))
    assert max(loads) <= greedy_heaviest(weights, 5) + max(weights) + 0.1 * sum(weights) / 5


def test_empty_folds_are_listed(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "kw1 string, kw2 string")
    summary = FO.split(pairs, 4)["summary"].orderBy("fold").collect()
    assert [r["fold"] for r in summary] == [1, 2, 3, 4]
    assert sorted(r["n_edges"] for r in summary) == [0, 0, 1, 1]


def test_communities_of_two_cliques(spark):
    def clique(prefix, n):
        return [(f"{prefix}{i:02}", f"{prefix}{j:02}") for i in range(n) for j in range(i + 1, n)]

    rows = clique("a", 12) + clique("b", 12) + clique("c", 12) + [("a00", "b00"), ("b01", "c01")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    labels = communities(edges, connected_components(edges))
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert len(got) == 36
    assert all(got[x][0] == x[0] for x in got)
    whole = labels.selectExpr("id", "'all' as community")
    assert modularity(edges, labels).first()[0] > modularity(edges, whole).first()[0] + 0.5
    nodes, blocks = FO.assign_blocks(edges.toDF("kw1", "kw2"), 20, 20)
    assert {r["block_type"] for r in blocks.collect()} == {"community"}
    assert nodes.count() == 36


def test_fold_pairings_meet_once():
    for k in (2, 3, 5, 6):
        rounds = FO.fold_pairings(k)
        met = [p for r in rounds for p in r]
        assert sorted(met) == [(a, b) for a in range(1, k + 1) for b in range(a + 1, k + 1)]
        assert all(len({f for p in r for f in p}) == 2 * len(r) for r in rounds)


def test_exchange_keeps_weights_and_worsens_nothing(spark):
    rng = random.Random(11)
    n, k = 300, 3
    weight = {b: rng.choice([1, 1, 1, 2, 3]) for b in range(n)}
    high = {b: rng.randrange(weight[b] + 1) for b in range(n)}
    # Blocks of one fold hold the high scores, and links run mostly inside groups that the folds cut.
    fold = {b: 1 + (b * k // n if rng.random() < 0.5 else b % k) for b in range(n)}
    high = {b: weight[b] if fold[b] == 1 else high[b] for b in range(n)}
    w = {}
    for _ in range(900):
        a, b = rng.randrange(n), rng.randrange(n)
        b = b if rng.random() < 0.2 else (a // 10) * 10 + rng.randrange(10)
        if a != b:
            w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0) + 1
    folds = spark.createDataFrame(sorted(fold.items()), "block_id long, fold int")
    stats = spark.createDataFrame(sorted(weight.items()), "block_id long, weight long")
    bins = spark.createDataFrame([(b, weight[b] - high[b], high[b]) for b in range(n)], "block_id long, bin_1 long, bin_2 long")
    cross = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "b1 long, b2 long, w long")

    def measures(of):
        table = [[0, 0] for _ in range(k)]
        load = [0] * k
        for b, f in of.items():
            table[f - 1][0] += weight[b] - high[b]
            table[f - 1][1] += high[b]
            load[f - 1] += weight[b]
        return load, FO.histogram_distance(table), sum(x for (a, b), x in w.items() if of[a] == of[b])

    def run(histogram, links):
        return {r["block_id"]: r["fold"] for r in FO.exchange_blocks(folds, stats, histogram, links, k, 0.5).collect()}

    load, distance, captured = measures(fold)
    after_load, after_distance, after_captured = measures(run(bins, cross))
    assert after_load == load
    assert after_distance < 0.5 * distance
    assert after_captured > captured
    assert run(None, cross.filter("w < 0")) == fold


def test_bad_parameters(spark):
    df = spark.createDataFrame([("a", "b", "x")], "kw1 string, kw2 string, score string")
    with pytest.raises(ValueError):
        FO.score_breaks(df, "score")
    with pytest.raises(ValueError):
        FO.block_stats(df, df, "weight")
