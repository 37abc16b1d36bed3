"""Samplers, flags, metrics, projection and topic helpers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasegraph.operators import evaluation as J
from phrasegraph.operators import phrases as P
from phrasegraph.operators import projection as PR
from phrasegraph.operators import sampling as H
from phrasegraph.operators import topics as K
from phrasegraph.plans import ordering as O
from phrasegraph.sources import tables as IO


@pytest.mark.parametrize("a, b, want", [("A", "B", "A||B"), ("B", "A", "A||B"), ("b", "b", "b||b"), ("z", "a", "a||z")])
def test_pair_key(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert row.select(H.pair_key(F.col("a"), F.col("b"))).first()[0] == want


def test_used_pairs(spark):
    phrases = spark.createDataFrame([("alpha", "K1"), ("beta", "K2"), ("gamma", "K3")], "phrase string, kid string")
    rows = [("alpha", "gamma"), ("beta", "alpha"), ("missing", "beta"), ("alpha", "gamma")]
    labels = spark.createDataFrame(rows, "kw1 string, kw2 string")
    assert {r["pair"] for r in H.used_pairs(labels, phrases).collect()} == {"K1||K3", "K1||K2"}
    assert H.used_pairs(labels.filter("kw1 = 'missing'"), phrases).count() == 0
    assert H.used_pairs(labels.limit(0), phrases).count() == 0


def test_single_partner_in_band(spark):
    sims = spark.createDataFrame([("a", "z", 0.5), ("a", "b", 0.9)], "id1 string, id2 string, cosine double")
    got = H.sample_distance_mid(sims, 10).collect()
    assert [(r["id1"], r["id2"]) for r in got] == [("a", "z")]


def test_hard_negative_without_shared_row(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.8, 0.3])], "id string, vec array<double>")
    inc = spark.createDataFrame([("a", 1), ("c", 1), ("b", 2), ("c", 2)], "kid string, doc_id long")
    got = H.sample_hard_negatives(vecs, inc, 10, 0.7, 0).collect()
    assert [(r["id1"], r["id2"]) for r in got] == [("a", "b")]


def test_flags_last_edit_wins(spark):
    phrases = spark.createDataFrame(
        [("1", "x", False, False, False), ("2", "y", False, True, False), ("3", "d", False, False, False), ("4", "d", False, False, False)],
        "kid string, phrase string, omit boolean, method boolean, thematic boolean",
    )
    cols = ["row_no", *[f"{f} {s}" for s in (1, 2) for f in ("keyword", "omit", "method", "thematic")]]
    sheet = spark.createDataFrame(
        [(1, "x", True, None, True, "y", None, False, None), (2, "x", False, None, None, "d", True, True, True)],
        ", ".join(f"`{c}` {'int' if c == 'row_no' else 'string' if c.startswith('keyword') else 'boolean'}" for c in cols),
    )
    got = {r["kid"]: (r["omit"], r["method"], r["thematic"]) for r in H.apply_flags(phrases, sheet, "row_no").collect()}
    assert got == {"1": (False, False, True), "2": (False, False, False), "3": (False,) * 3, "4": (False,) * 3}


def test_zero_is_in_no_bin(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.1), (1, 0.2), (1, 1.0)], "fold int, value double")
    row = J.label_histogram(rows).first()
    assert row["bin_1"] == pytest.approx(2 / 3) and row["bin_5"] == pytest.approx(1 / 3)


def test_empty_fold_is_an_error(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5)], "fold int, value double")
    with pytest.raises(ValueError):
        J.require_cv(rows)
    assert J.require_cv(rows, (1, 2)).count() == 4


def test_ranks_and_quantiles(spark):
    rng = random.Random(2)
    values = [float(rng.choice([0, 0, 0, 1, 2, 3, 5, 8])) for _ in range(101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {r["i"]: r["r"] for r in O.with_average_rank(df, "v", "r").collect()}
    order = sorted(values)
    for i, v in enumerate(values):
        places = [k + 1 for k, w in enumerate(order) if w == v]
        assert got[i] == sum(places) / len(places)
    probs = [0, 0.13, 0.5, 0.77, 1]
    found = {r["prob"]: r["value"] for r in O.exact_quantiles(df, "v", probs).collect()}
    assert [found[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))


def test_pca_is_orthonormal_and_complete(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 4
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, vec array<double>")
    fit = PR.fit_pca(df)
    assert np.allclose(fit.loadings.T @ fit.loadings, np.eye(6), atol=1e-8)
    assert fit.evr.sum() == pytest.approx(1) and all(np.diff(fit.evr) <= 1e-12)
    lead = np.abs(fit.loadings).argmax(axis=0)
    assert (fit.loadings[lead, np.arange(6)] > 0).all()
    scores = np.array([r["vec"] for r in PR.pc_scores(df, fit).orderBy("id").collect()])
    assert np.allclose(scores, (x - x.mean(axis=0)) @ fit.loadings)
    rest = np.array([r["vec"] for r in PR.remove_top_pcs(df, fit, 2).orderBy("id").collect()])
    assert np.allclose(rest @ fit.loadings[:, :2], 0, atol=1e-9)


def test_knee(spark):
    evr = [0.5, 0.3, 0.1, 0.05, 0.05]
    spec = spark.createDataFrame([(i + 1, v) for i, v in enumerate(evr)], "m int, evr double")
    assert PR.knee_index(spec).first()["m_knee"] == 2
    assert {r["target"]: r["m"] for r in PR.evr_targets(spec, (0.79, 2.0)).collect()} == {0.79: 2, 2.0: None}


def test_log_factorial(spark):
    got = spark.range(0, 200).select("id", K.log_factorial(F.col("id")).alias("v")).collect()
    for r in got:
        assert r["v"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-12, abs=1e-12)


def test_pairs_merge_left_to_right(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "a", "b", "a", "a"]), (2, []), (3, ["q"])], "doc_id long, words array<string>")
    found = spark.createDataFrame([("a", "a", 9), ("a", "b", 9)], "a string, b string, n_ab long")
    got = {r["doc_id"]: r["words"] for r in P.merge_pairs(rows, found).collect()}
    assert got == {1: ["a_a", "a_b", "a_a"], 2: [], 3: ["q"]}


def test_merging_moves_no_row_per_word(spark, monkeypatch):
    """Blocks of a few words give the rows of one block, and a repeated pair has one row per block."""
    words = [["a", "b", "a", "b", "b"], ["x"], [], None, ["b", "a", "a", "b"]] * 5
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, words array<string>")
    found = spark.createDataFrame([("a", "b", 5)], "a string, b string, n_ab long")
    want = {i: [x for x in {5: ["a_b", "a_b", "b"], 1: ["x"], 4: ["b", "a", "a_b"]}.get(len(w or []), [])] for i, w in enumerate(words)}
    assert {r["doc_id"]: r["words"] for r in P.merge_pairs(rows, found).collect()} == want
    counts = P.grams(P.in_blocks(rows)).filter("a = 'a' and b = 'b'").collect()
    assert len(counts) == 1 and counts[0]["n"] == 15
    monkeypatch.setattr(P, "BLOCK_WORDS", 7)
    assert {r["doc_id"]: r["words"] for r in P.merge_pairs(rows, found).collect()} == want


def test_phrase_lists_are_cut_into_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(IO, "CHUNK_DOCS", 10)
    postings = spark.createDataFrame([("1", d, d % 3 + 1) for d in range(95)] + [("2", 5, 1)], "kid string, doc_id long, n long")
    phrases = spark.createDataFrame(
        [("1", "big thing", 95, False, None, True), ("2", "small thing", 1, True, False, False)],
        "kid string, phrase string, doc_count long, omit boolean, method boolean, thematic boolean",
    )
    rows = IO.phrase_rows(phrases, postings).collect()
    assert max(len(r["award_ids"].split(",")) for r in rows) < 30 and len(rows) > 5
    path = str(tmp_path / "phrases")
    IO.write_phrases(phrases, postings, path)
    table, back = IO.read_phrases(spark, path)
    assert {(r["kid"], r["omit"], r["method"]) for r in table.collect()} == {("1", False, False), ("2", True, False)}
    assert {(r["kid"], int(r["doc_id"]), r["n"]) for r in back.collect()} == {(r["kid"], r["doc_id"], r["n"]) for r in postings.collect()}


def test_phrases_without_postings_survive(spark, tmp_path):
    phrases = spark.createDataFrame(
        [("1", "big thing", 1, False, False, False), ("2", "lone thing", 0, True, False, False), ("3", "new thing", None, False, True, False)],
        "kid string, phrase string, doc_count long, omit boolean, method boolean, thematic boolean",
    )
    postings = spark.createDataFrame([("1", 7, 2)], "kid string, doc_id long, n long")
    path = str(tmp_path / "phrases")
    IO.write_phrases(phrases, postings, path)
    table, back = IO.read_phrases(spark, path)
    assert {(r["phrase"], r["omit"], r["method"]) for r in table.collect()} == {
        ("big thing", False, False), ("lone thing", True, False), ("new thing", False, True)
    }
    assert [(r["kid"], r["doc_id"], r["n"]) for r in back.collect()] == [("1", "7", 2)]


def test_runs_and_matches_of_any_length(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    assert [r["length"] for r in P.candidate_phrases(docs).collect()] == [6]
    assert P.candidate_phrases(docs, max_len=5).count() == 0
    wanted = spark.createDataFrame([("beta gamma delta epsilon zeta", 1), ("alpha beta", 1)], "phrase string, n long")
    got = {r["phrase"] for r in P.phrase_matches(wanted, docs, min_doc_count=1).collect()}
    assert got == {"beta gamma delta epsilon zeta", "alpha beta"}
    assert P.phrase_matches(wanted.limit(0), docs, min_doc_count=1).count() == 0


def test_random_sample_returns_every_unused_pair(spark):
    ids = spark.createDataFrame([(f"k{i:02d}",) for i in range(30)], "id string")
    rows = [(f"k{a:02d}||k{b:02d}",) for a in range(30) for b in range(a + 1, 30)]
    left = {rows[3][0], rows[200][0], rows[400][0]}
    used = spark.createDataFrame([r for r in rows if r[0] not in left], "pair string")
    for n in (1, 3, 5):
        got = {f"{r['id1']}||{r['id2']}" for r in H.sample_random(ids, n, 1, used).collect()}
        assert got <= left and len(got) == min(n, 3)


def test_bundle_refuses_missing_features(spark, tmp_path):
    cells = spark.createDataFrame([(1, 1, 2)], "ii long, jj long, vv long")
    docs, kids = spark.createDataFrame([("d", 1)], "doc_id string, ii long"), spark.createDataFrame([("k", 1)], "kid string, jj long")
    e = spark.createDataFrame([("k", [1.0, 2.0])], "id string, vec array<double>")
    with pytest.raises(ValueError):
        K.write_bundle(str(tmp_path / "bundle"), cells, e, e, docs, kids)


def test_labels_file_may_be_missing_or_unnamed(spark, tmp_path):
    assert IO.read_labels(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "labels")
    IO.write_csv(spark.createDataFrame([("x", "y, z", 0.5)], "a string, b string, c double"), path)
    assert [tuple(r) for r in IO.read_labels(spark, path).collect()] == [("x", "y, z", 0.5, None)]


def test_vectors_keep_numeric_order(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df = spark.createDataFrame([("k", [float(i) for i in range(12)])], "kid string, vec array<double>")
    IO.write_vectors(df, path, "kid")
    assert IO.read_vectors(spark, path, "kid").first()["vec"] == [float(i) for i in range(12)]
    with pytest.raises(ValueError):
        IO.write_vectors(df.union(df), str(tmp_path / "twice"), "kid")
