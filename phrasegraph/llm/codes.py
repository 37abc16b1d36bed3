"""Vector codes by product quantisation; the codebooks are fitted by ball k-means."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, steps

#: Components are compared as integers: ``floor(SCALE * x)``.
SCALE = 256

#: Integers beyond this in size count as this, so that 64 bits hold every sum of squares.
LIMIT = 1 << 26

#: Components of a batch that are worked on at a time.
BLOCK = 1 << 20


def usable(column: str) -> Column:
    """Whether a vector is present and all of its components are finite numbers."""
    fine = F.forall(
        F.col(column).cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.col(column).isNotNull() & F.coalesce(fine, F.lit(False))


def as_integers(column: str) -> Column:
    """``floor(256 * x)`` of each component, at most ``LIMIT`` in size."""
    return F.transform(
        F.col(column).cast("array<double>"),
        lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"),
    )


@dataclass(frozen=True)
class Balls:
    """Codebooks with, for each entry, the entries that its ball can lose parts to.

    ``entries[p, e]`` is an entry. ``near[p, e]`` lists neighbours of the entry by growing distance and
    ``gap[p, e]`` the squared distances. A neighbour is an entry whose centre is at most
    twice the ball's radius away: by the triangle inequality no other can be as close to
    any part inside. ``resting[p, e]`` marks balls of which neither the centre nor a neighbour's moved.
    """

    entries: np.ndarray
    near: np.ndarray
    gap: np.ndarray
    resting: np.ndarray

    @staticmethod
    def around(entries: np.ndarray, before: np.ndarray, widest: np.ndarray) -> Balls:
        """``widest[p, e]``: the largest squared distance of a part to its entry in ``before``.

        A radius is bounded by the distance to the old centre and the way the centre moved, both
        rounded up to integers, so the neighbour lists are never too short.
        """
        moved = ((entries - before) ** 2).sum(axis=2)
        root = np.vectorize(lambda x: math.isqrt(int(x)) + (math.isqrt(int(x)) ** 2 < x), otypes=[np.int64])
        radius = root(widest) + root(moved)
        count = entries.shape[1]
        gap = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=3)
        never = np.iinfo(np.int64).max
        reach = np.where(gap <= 4 * radius[:, :, None] ** 2, gap, never)
        reach[:, np.arange(count), np.arange(count)] = never
        order = np.argsort(reach, axis=2, kind="stable")
        sorted_gap = np.take_along_axis(reach, order, axis=2)
        still = moved == 0
        calm = np.where(sorted_gap < never, np.take_along_axis(np.broadcast_to(still[:, None, :], gap.shape), order, 2), True)
        return Balls(entries, order, sorted_gap, still & calm.all(axis=2))


def nearest(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first assignment: every entry of ``entries[p]`` is compared with each of ``parts[:, p]``."""
    out = np.empty(parts.shape[:2], np.int64)
    for p in range(parts.shape[1]):
        distance = np.zeros((len(parts), entries.shape[1]), np.int64)
        for d in range(parts.shape[2]):
            distance += (parts[:, p, d, None] - entries[p, None, :, d]) ** 2
        out[:, p] = distance.argmin(axis=1)
    return out


def own_distance(parts: np.ndarray, codes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each part to the entry it is coded by."""
    chosen = entries[np.arange(entries.shape[0])[None, :], codes]
    return ((parts - chosen) ** 2).sum(axis=2)


def reassigned(parts: np.ndarray, codes: np.ndarray, balls: Balls) -> np.ndarray:
    """The nearest entries, from an assignment to the same entries before they moved.

    A part at distance d from its centre c can be as close to a neighbour n only if 4 d^2 >= |cn|^2. So
    parts in a ball's core (no such neighbour) are left alone; in the ring between the k-th and the next
    neighbour exactly the first k are compared. All comparisons are between integers.
    """
    n, positions, _ = parts.shape
    distance = own_distance(parts, codes, balls.entries).reshape(-1)
    flat, home = parts.reshape(n * positions, -1), codes.reshape(-1)
    place = np.tile(np.arange(positions), n)
    best, best_distance = home.copy(), distance.copy()
    active = np.flatnonzero(~balls.resting[place, home])
    for k in range(balls.near.shape[2] - 1):
        ring = balls.gap[place[active], home[active], k]
        active = active[ring <= 4 * distance[active]]
        if not len(active):
            break
        other = balls.near[place[active], home[active], k]
        away = ((flat[active] - balls.entries[place[active], other]) ** 2).sum(axis=1)
        closer = (away < best_distance[active]) | ((away == best_distance[active]) & (other < best[active]))
        best[active[closer]], best_distance[active[closer]] = other[closer], away[closer]
    return best.reshape(n, positions)


def _blocks(batch: pa.RecordBatch, positions: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch with their parts; vectors end in zeros up to ``positions * width``."""
    rows = max(1, BLOCK // (positions * width))
    for at in range(0, len(batch), rows):
        piece = batch.slice(at, rows)
        column = piece.column("q")
        sizes = np.asarray(column.value_lengths())
        parts = np.zeros((len(piece), positions * width), np.int64)
        parts[np.arange(parts.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
        yield piece, parts.reshape(len(piece), positions, width)


def _codes(piece: pa.RecordBatch, positions: int) -> np.ndarray:
    raw = b"".join(piece.column("code").to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(piece), positions).astype(np.int64)


def _coded(state: DataFrame, books: np.ndarray, balls: Balls | None) -> DataFrame:
    """``state`` with new ``code`` bytes and ``error``, the squared distances summed over parts."""
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, parts in _blocks(batch, positions, width):
                codes = nearest(parts, books) if balls is None else reassigned(parts, _codes(piece, positions), balls)
                error = own_distance(parts, codes, books).sum(axis=1)
                raw = [row.tobytes() for row in codes.astype(np.uint8)]
                columns = [piece.column(c) for c in ("vec_id", "label", "q")]
                yield pa.record_batch([*columns, pa.array(raw, pa.binary()), pa.array(error)], ["vec_id", "label", "q", "code", "error"])

    schema = state.select("vec_id", "label", "q").schema.add("code", "binary").add("error", "long")
    return state.mapInArrow(run, schema)


def _summed(state: DataFrame, books: np.ndarray) -> DataFrame:
    """``position, entry, n, widest, total``: per task one row for each entry in use, then added up."""
    positions, count, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(positions * count, np.int64)
        widest = np.zeros(positions * count, np.int64)
        total = np.zeros((positions * count, width), np.int64)
        for batch in batches:
            for piece, parts in _blocks(batch, positions, width):
                codes = _codes(piece, positions)
                cell = (codes + np.arange(positions) * count).reshape(-1)
                n += np.bincount(cell, minlength=len(n))
                np.maximum.at(widest, cell, own_distance(parts, codes, books).reshape(-1))
                np.add.at(total, cell, parts.reshape(-1, width))
        used = np.flatnonzero(n)
        for component in range(width):
            columns = [used // count, used % count, np.full(len(used), component), n[used], widest[used], total[used, component]]
            yield pa.record_batch([pa.array(c) for c in columns], names)

    names = ["position", "entry", "component", "n", "widest", "total"]
    parts = state.select("q", "code").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("position", "entry", "component").agg(
        F.sum("n").alias("n"), F.max("widest").alias("widest"), F.sum("total").alias("total")
    )


def _moved(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries as floors of their parts' means, unused ones unchanged; and the balls' extents.

    The driver gets one row per entry and component: a number set by the parameters, not by the data.
    """
    moved, widest = books.copy(), np.zeros(books.shape[:2], np.int64)
    for row in _summed(state, books).toLocalIterator():
        moved[row.position, row.entry, row.component] = row.total // row.n
        widest[row.position, row.entry] = row.widest
    return moved, widest


def compress(
    vectors: DataFrame,
    positions: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for each usable vector.

    A vector's components become ``floor(256 * x)`` and are cut into ``positions`` equal parts. Each part
    position has a codebook that starts as that part of the ``entries`` smallest ids. A round
    assigns every part to the nearest entry (ties to the lower index) and moves each entry to the floor
    of its parts' mean; an entry without parts stays. After ``rounds`` rounds parts are assigned again.
    ``code`` holds two hex digits a part, ``error`` the squared distances to the entries,
    ``label_error`` their sum over equal labels (null is a label).

    Rounds are exact ball k-means: entry balls with their radii name the neighbour entries (``Balls``), parts in
    stable cores are not compared and each ring compares its own candidates (``reassigned``). A round is
    two scans without a shuffle of vectors; only sums per entry move.

    Rows without a vector, or with a null or non-finite component, are dropped. A null id is coded but starts no
    entry. Repeated ids are rows of their own; where they start entries, the smaller vector is first. Vectors
    shorter than the longest, or than a multiple of ``positions``, count as zero beyond their end. Sizes over
    ``LIMIT`` (262,144 before scaling) count as ``LIMIT``. Fewer vectors than ``entries`` give smaller
    codebooks. An empty table gives no rows. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256: a code is one byte")
    with steps(vectors.sparkSession) as scope:
        state = durable(
            vectors.filter(usable(vec_col)).select(
                F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), as_integers(vec_col).alias("q")
            )
        )
        longest = state.agg(F.max(F.size("q"))).first()[0] or 1
        width = -(-longest // positions)
        first = state.filter("vec_id is not null").orderBy("vec_id", "q").limit(entries).select("q").collect()
        start = np.zeros((len(first), positions * width), np.int64)
        for i, row in enumerate(first):
            start[i, : len(row.q)] = row.q
        if not first:
            # Without any id there is nothing to start from: all parts are coded by one entry of zeros.
            start = np.zeros((1, positions * width), np.int64)
        books = np.ascontiguousarray(start.reshape(-1, positions, width).transpose(1, 0, 2))
        balls = None
        for _ in range(rounds):
            coded = durable(_coded(state, books, balls))
            scope.drop(state)
            state, before = coded, books
            books, widest = _moved(state, before)
            balls = Balls.around(books, before, widest)
        done = durable(_coded(state, books, balls).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
        scope.drop(state)
        per_label = durable(done.groupBy("label").agg(F.sum("error").alias("label_error")))
        per_label = per_label.withColumnRenamed("label", "_label")
        digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
        return scope.keep(
            done.join(per_label, F.col("label").eqNullSafe(F.col("_label")))
            .drop("_label")
            .withColumn("codebooks_sha256", F.lit(digest))
        )
