"""Vector codes and hard negatives against brute force, on rows with every odd case."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasegraph.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string, row int, lane string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, lab, "x", 1, "y") for i, v, lab in rows], SCHEMA)


def fixture(n=240, width=8, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-1, 1]) * rng.random() ** 2 for _ in range(width)]
        rows.append((i, v, rng.choice([None, 1, 2, 3])))
    rows += [(i, rows[3][1], 1) for i in range(n, n + 30)]  # ties
    rows += [(7, rows[9][1], 2), (7, rows[9][1], 2), (None, rows[1][1], 1), (None, rows[4][1], 3)]
    rows += [(900, None, 1), (901, [NAN] * width, 1), (902, [INF] * width, 2), (903, [None] + [0.0] * (width - 1), 2)]
    rows += [(-5, [1e30] * width, 3), (950, [0.5], 2), (951, [], 1)]
    return rows


def kept(rows):
    out = []
    for i, v, label in rows:
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        q = [max(-codes.LIMIT, min(codes.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v]
        out.append((i, q, label))
    return out


def brute_codes(rows, positions, entries, rounds):
    rows = kept(rows)
    longest = max((len(q) for _, q, _ in rows), default=1) or 1
    width = -(-longest // positions)
    full = [(i, q + [0] * (positions * width - len(q)), lab) for i, q, lab in rows]
    parts = [[q[p * width : (p + 1) * width] for p in range(positions)] for _, q, _ in full]
    order = sorted((i, q) for i, q, _ in rows if i is not None)[:entries]
    books = [[(q + [0] * (positions * width - len(q)))[p * width : (p + 1) * width] for _, q in order] for p in range(positions)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for row in parts:
            for p, part in enumerate(row):
                members[p, near(p, part)[1]].append(part)
        for (p, k), found in members.items():
            books[p][k] = [sum(c) // len(found) for c in zip(*found)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, per_label = [], defaultdict(int)
    for (i, _, label), row in zip(full, parts):
        best = [near(p, part) for p, part in enumerate(row)]
        error = sum(d for d, _ in best)
        per_label[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), error))
    return sorted(((*r, per_label[r[1]], digest) for r in out), key=str)


@pytest.mark.parametrize("positions, entries, rounds", [(4, 16, 2), (3, 5, 3), (1, 64, 1), (4, 256, 0)])
def test_codes_equal_brute_force(spark, positions, entries, rounds):
    rows = fixture()
    got = codes.compress(vectors(spark, rows), positions, entries, rounds)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, positions, entries, rounds)


def test_codes_of_few_and_no_vectors(spark):
    assert codes.compress(vectors(spark, [])).count() == 0
    assert codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    lonely = codes.compress(vectors(spark, [(None, [0.5] * 16, None)])).collect()
    assert [(r.vec_id, r.code, r.error) for r in lonely] == [(None, "00" * 16, 0)]


def test_rings_compare_few_entries(spark):
    """Later rounds compare parts with few entries, and find what a full search finds."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (1, 64, 4))
    parts = (centres[0][rng.integers(0, 64, 3000)] + rng.integers(-40, 40, (3000, 4)))[:, None, :]
    before = centres + rng.integers(-5, 5, centres.shape)
    held = codes.nearest(parts, before)
    widest = np.zeros((1, 64), np.int64)
    np.maximum.at(widest[0], held[:, 0], codes.own_distance(parts, held, before)[:, 0])
    balls = codes.Balls.around(centres, before, widest)
    assert (codes.reassigned(parts, held, balls) == codes.nearest(parts, centres)).all()
    assert (balls.gap < np.iinfo(np.int64).max).sum() < 64 * 63 / 10
    still = codes.Balls.around(centres, centres, widest)
    assert still.resting.all()


@pytest.mark.parametrize("size", [1, 5, 128, 2000, 1 << 20, 1 << 26])
@pytest.mark.parametrize("width", [1, 7, 64])
def test_packed_scores_are_exact(size, width):
    rng = np.random.default_rng(size + width)
    a, r = rng.integers(-size, size + 1, (9, width)), rng.integers(-size, size + 1, (13, width))
    assert (negatives.packed_scores(a, r) == a @ r.T).all()
    assert negatives.packed_scores(a, r[:0]).shape == (9, 0)


def brute_negatives(rows, every, positives, count, band):
    rows = [r for r in kept(rows) if r[2] is not None]
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, q, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(dot(q, r[1]), r[0], r[2]) for m, r in enumerate(rows) if m != n]
        best = sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:positives]
        for score, pid, _ in best:
            far = [s for s in scored if s[2] != label and band[0] * score <= 100 * s[0] <= band[1] * score]
            far.sort(key=lambda s: (-s[0], last(s[1])))
            out += [(i, pid, k + 1, s[1], score, s[0]) for k, s in enumerate(far[:count])]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_size", [3, 10_000])
def test_negatives_equal_brute_force(spark, monkeypatch, slice_size):
    monkeypatch.setattr(negatives, "ANCHORS", slice_size)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 50)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    rows = fixture()
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 7 == 0, 3, 4, (30, 90))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows, 7, 3, 4, (30, 90))


def test_negatives_of_nothing(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], None), (1, None, 1)]):
        assert negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 7 == 0).count() == 0
