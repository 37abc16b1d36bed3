"""Cells of unit vectors around pivots, and lower bounds on the angles between them.

Every row goes to its nearest pivot; a pivot's rows are cut into rings by their angle to it and, where one
ring is too full, into chunks. A cell is one chunk, packed into one row with its matrix. For rows x and y of
cells around the pivots p and q, at most h from them and at least l,

    angle(x, y) >= max(angle(p, q) - h_x - h_y, l_x - angle(p, q) - h_y, l_y - angle(p, q) - h_x)

so a pair of cells whose bound is above the angle that is looked for is never joined. The bounds are exact
inequalities: what is skipped cannot hold a result.

A zero vector has the cosine 0 with everything and no angle; such rows form cells whose bound is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, steps

#: Rows of a cell, about.
CELL_ROWS = 1_000

#: Pivots of one variant at most; each task holds all of them.
PIVOTS = 1_024

#: Carried entries that count as one row of a cell, so that a cell of long rows has fewer of them.
ROW_ENTRIES = 128

#: Rings of a pivot at most.
RINGS = 32

#: Pairs of a cell, on average, up to which matrices are moved to them.
SPARSE_PAIRS = 4

#: Angles below are not told apart from rounding.
SLACK = 1e-6

_RING, _CHUNK = 64, 1 << 24

#: Numbers of a variant's cells: pivot, ring and chunk.
VARIANT_CELLS = (PIVOTS + 1) * _RING * _CHUNK


@dataclass(frozen=True)
class Cells:
    """``packed`` has ``cell, ids, m``; the arrays describe the cells in the order of ``cell``.

    Carried columns follow, and ``sizes``, the number of entries a row has in each. One entry a cell, that is one for about ``CELL_ROWS`` rows, is held by the driver and the tasks.
    """

    packed: DataFrame
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    angles: dict[int, np.ndarray]
    id_type: str
    carried: tuple[str, ...] = ()

    @property
    def variant(self) -> np.ndarray:
        return self.cell // VARIANT_CELLS

    @property
    def pivot(self) -> np.ndarray:
        return self.cell // _CHUNK // _RING % (PIVOTS + 1)

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cells of the same variant and the least angle of their rows to rows of cell ``i``."""
        others = np.flatnonzero(self.variant == self.variant[i])
        pivots, mine = self.pivot[others], self.pivot[i]
        between = np.zeros(len(others))
        zero = (pivots == PIVOTS) | (mine == PIVOTS)
        known = self.angles[int(self.variant[i])]
        if mine != PIVOTS:
            between[~zero] = known[mine, pivots[~zero]]
        low, high = self.low[others], self.high[others]
        least = np.maximum(between - self.high[i] - high, np.maximum(self.low[i] - between - high, low - between - self.high[i]))
        return others, np.where(zero, 0.0, np.maximum(least - SLACK, 0.0))

    def pairs(self, spark, pick: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """``p, qs``: the cells ``qs`` that ``pick(i, positions, bounds)`` chooses for each cell ``p``, if any."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    others, least = self_.bounds(i)
                    chosen = self_.cell[pick(i, others, least)]
                    if len(chosen):
                        yield pa.record_batch([pa.array([self_.cell[i]]), pa.array([chosen], pa.list_(pa.int64()))], ["p", "qs"])

        self_ = Cells(None, self.cell, self.low, self.high, self.rows, self.angles, self.id_type)
        tasks = max(1, min(len(self.cell), spark.sparkContext.defaultParallelism))
        return durable(spark.range(0, len(self.cell), 1, tasks).mapInArrow(run, "p long, qs array<long>"))


def n_pairs(pairs: DataFrame) -> int:
    return pairs.agg(F.coalesce(F.sum(F.size("qs")), F.lit(0)).alias("n")).first()["n"]


def unpacked(batch: pa.RecordBatch, row: int, ids: int, matrix: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one cell of a batch."""
    names = batch.column(ids)[row].values.to_numpy(zero_copy_only=False)
    return names, np.frombuffer(batch.column(matrix)[row].as_buffer(), np.float64).reshape(len(names), -1)


def _load(carried: tuple[str, ...]) -> Column:
    """Rows of a cell, those with many carried entries for several."""
    return F.sum(F.greatest(F.lit(1.0), F.size(carried[0]) / ROW_ENTRIES)) if carried else F.count(F.lit(1))


def _cut(placed: DataFrame, number: Column, cell_rows: int, carried: tuple[str, ...]) -> DataFrame:
    """``cell, id, vec, angle`` and ``carried``: rows of crowded pivots in rings, rows of crowded rings in chunks by their id."""
    load = _load(carried)
    per_pivot = placed.groupBy("_v", "pivot").agg(
        load.alias("_n"), F.percentile_approx("angle", [i / RINGS for i in range(1, RINGS)]).alias("_edges")
    )
    crowded = per_pivot.filter(F.col("_n") > 2 * cell_rows).select(
        "_v", "pivot", "_edges", F.least(F.lit(RINGS), F.ceil(F.col("_n") / cell_rows)).alias("_rings")
    )
    above = F.size(F.filter("_edges", lambda e: e < F.col("angle")))
    ring = F.coalesce(F.floor(above * F.col("_rings") / RINGS), F.lit(0))
    ringed = placed.join(F.broadcast(crowded), ["_v", "pivot"], "left").withColumn("_ring", ring.cast("long"))
    full = ringed.groupBy("_v", "pivot", "_ring").agg(load.alias("_n")).filter(F.col("_n") > 2 * cell_rows)
    full = full.withColumn("_chunks", F.ceil(F.col("_n") / cell_rows)).drop("_n")
    ringed = ringed.join(F.broadcast(full), ["_v", "pivot", "_ring"], "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_chunks")), F.lit(0))
    key = (number + F.col("_ring")) * _CHUNK + chunk
    return ringed.select(key.cast("long").alias("cell"), "id", "vec", "angle", *carried)


def build(units: DataFrame, cell_rows: int = CELL_ROWS, carried: tuple[str, ...] = ()) -> Cells:
    """Cells of ``_v, id, vec``: unit vectors (or zeros) of equal width within each variant number ``_v``.

    ``carried`` are arrays of numbers, of one length within a row, that are packed along with it. The steps taken are deleted.
    """
    with steps(units.sparkSession) as scope:
        cells = _built(units, cell_rows, carried)
        return replace(cells, packed=scope.keep(cells.packed, large_rows=True))


def _built(units: DataFrame, cell_rows: int, carried: tuple[str, ...]) -> Cells:
    spark = units.sparkSession
    kind = units.schema["id"].dataType.simpleString()
    counts = {r["_v"]: r["n"] for r in units.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots, angles = {}, {}
    for v, n in counts.items():
        most = min(PIVOTS, -(-n // cell_rows))
        some = F.exists("vec", lambda x: x != 0)
        chosen = units.filter((F.col("_v") == v) & some).orderBy(F.xxhash64("id"), "id").limit(most).select("vec").collect()
        pivots[v] = np.array([r["vec"] for r in chosen]) if chosen else np.zeros((0, 1))
        angles[v] = np.arccos(np.clip(pivots[v] @ pivots[v].T, -1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            variants = batch.column(0).to_numpy()
            nearest, angle = np.full(len(batch), PIVOTS), np.zeros(len(batch))
            for v in np.unique(variants):
                rows = np.flatnonzero(variants == v)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    matrix = np.array(batch.column(2).take(pa.array(part)).to_pylist(), np.float64)
                    live = matrix.any(axis=1) if matrix.size else np.zeros(len(part), bool)
                    if live.any():
                        cosine = matrix[live] @ pivots[v].T
                        nearest[part[live]] = cosine.argmax(axis=1)
                        angle[part[live]] = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(nearest), pa.array(angle)], [*batch.schema.names, "pivot", "angle"])

    rows = units.select("_v", "id", "vec", *carried)
    placed = durable(rows.mapInArrow(place, units.select("_v", "id", "vec", *carried).schema.add("pivot", "long").add("angle", "double")))
    number = (F.col("_v").cast("long") * (PIVOTS + 1) + F.col("pivot")) * _RING
    extent = [F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"), _load(carried).alias("load")]
    # One row a pivot; most data need no finer cells.
    table = placed.groupBy((number * _CHUNK).alias("cell")).agg(*extent).collect()
    if all(r["load"] <= 2 * cell_rows for r in table):
        celled = placed.select((number * _CHUNK).alias("cell"), "id", "vec", *carried)
    else:
        celled = durable(_cut(placed, number, cell_rows, carried))
        table = celled.groupBy("cell").agg(*extent[:3]).collect()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        matrix = np.stack(frame["vec"].to_numpy()).astype(np.float64)
        cell = {"cell": [frame["cell"].iat[0]], "ids": [frame["id"].to_numpy()], "m": [matrix.tobytes()]}
        for c in carried:
            cell[c] = [np.concatenate(frame[c].to_numpy()).tobytes()]
        if carried:
            cell["sizes"] = [frame[carried[0]].map(len).to_numpy(np.int64).tobytes()]
        return pd.DataFrame(cell)

    more = [f"{c} binary" for c in (*carried, "sizes")] if carried else []
    packed = celled.select("cell", "id", "vec", *carried).groupBy("cell").applyInPandas(pack, ", ".join(["cell long", f"ids array<{kind}>", "m binary", *more]))
    table = sorted(tuple(r) for r in table)
    cell, low, high, n = (np.array([r[i] for r in table], t) for i, t in enumerate((np.int64, float, float, np.int64)))
    return Cells(packed, cell, low, high, n, angles, kind, (*carried, "sizes") if carried else ())


def joined(cells: Cells, pairs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``p, q, ids1, m1, ids2, m2``: each pair of cells with both matrices, and the columns of ``extra`` (``p, ...``).

    Few pairs a cell are joined by their keys, which moves at most ``SPARSE_PAIRS`` matrices a cell. Where bounds bar
    little, a matrix would be moved once for every other cell; there Spark's Cartesian product reads the written
    cells part by part and nothing is shuffled. It gives the rows of one ``p`` in succession. Cells with carried columns, which
    follow as ``<name>1`` and ``<name>2``, are never moved.
    """
    both_sides = [[F.col(c).alias(f"{c}{side}") for c in ("ids", "m", *cells.carried)] for side in "12"]
    first = cells.packed.select(F.col("cell").alias("p"), *both_sides[0])
    if extra is not None:
        first = first.join(extra, "p")
    second = cells.packed.select(F.col("cell").alias("q"), *both_sides[1])
    if not cells.carried and n_pairs(pairs) <= SPARSE_PAIRS * len(cells.cell):
        both = pairs.select("p", F.explode("qs").alias("q")).join(second, "q").join(first, "p")
    else:
        both = first.join(pairs, "p").join(second.hint("shuffle_replicate_nl"), F.expr("array_contains(qs, q)"))
    carried = [f"{c}{side}" for c in cells.carried for side in "12"]
    return both.select("p", "q", "ids1", "m1", "ids2", "m2", *carried, *[c for c in (extra.columns if extra else []) if c != "p"])
