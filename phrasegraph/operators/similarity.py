"""Dense vectors: normalising, exact cosine joins and nearest neighbours.

Rows lie in cells around pivots (``cells``). Pairs of cells that cannot hold a result are skipped by exact
bounds; each remaining pair is one row with two small matrices, so no key is hot and memory per task
is fixed. A task returns only what was asked for: pairs above a threshold, the best k per row, or one
label per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dense import as_doubles, dot, l2_unit
from ..plans.durable import durable, steps
from ..plans.skew import lookup
from .cells import CELL_ROWS, VARIANT_CELLS, Cells, build, joined, n_pairs, unpacked
from .graph import connected_components


#: Above this many ids the whole triangle must be asked for explicitly.
TRIANGLE_IDS = 20_000


def normalized(df: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """``id, vec`` with unit vectors of doubles; zero vectors stay zero."""
    doubles = df.select(F.col(id_col).alias("id"), as_doubles(F.col(vec_col)).alias("vec"))
    return doubles.select("id", l2_unit(F.col("vec")).alias("vec"))


def _ids_first(names: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = names[i], other[j]
    swap = a > b
    return np.where(swap, b, a), np.where(swap, a, b)


def _within(angle: float):
    """Choose each pair of cells once, if rows of both can be within ``angle``."""
    return lambda i, others, least: others[(others >= i) & (least <= angle)]


def _checked(threshold: float) -> float:
    if not -1.0 < threshold < 1.0:
        raise ValueError("the similarity threshold must lie in (-1, 1)")
    return threshold


def _one_variant(units: DataFrame) -> DataFrame:
    return units.select(F.lit(0).alias("_v"), "id", "vec")


def _threshold_pairs(units: DataFrame, threshold: float, diagonal: bool, cell_rows: int) -> DataFrame:
    cells = build(_one_variant(units), cell_rows)
    near = joined(cells, cells.pairs(units.sparkSession, _within(math.acos(max(-1.0, threshold)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(2).type.value_type
            for row in range(len(batch)):
                left, a = unpacked(batch, row, 2, 3)
                right, b = unpacked(batch, row, 4, 5)
                sims = a @ b.T
                keep = sims > threshold
                if batch.column(0)[row] == batch.column(1)[row]:
                    keep &= np.triu(np.ones_like(keep), 0 if diagonal else 1)
                i, j = np.nonzero(keep)
                first, second = _ids_first(left, right, i, j)
                yield pa.record_batch([pa.array(first, kind), pa.array(second, kind), pa.array(sims[i, j])], ["id1", "id2", "cosine"])

    return near.mapInArrow(run, f"id1 {cells.id_type}, id2 {cells.id_type}, cosine double")


def similar_pairs(
    df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``id1 < id2, cosine`` for cosine strictly above the threshold; exact.

    The pairs, many more than the rows, are not written here: each action on the frame joins the cells again.
    """
    _checked(threshold)
    return _threshold_pairs(durable(normalized(df, id_col, vec_col)), threshold, False, cell_rows)


def pairwise_cosine(
    df: DataFrame, id_col: str = "id", vec_col: str = "vec", allow_large: bool = False, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The upper triangle with its diagonal, not written here. Its size is quadratic, hence the explicit opt-in."""
    units = durable(normalized(df, id_col, vec_col))
    if not allow_large and units.count() > TRIANGLE_IDS:
        raise ValueError("too many ids for a full triangle; use similar_pairs or allow_large=True")
    return _threshold_pairs(units, -math.inf, True, cell_rows)


def similarity_components(
    df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``id, component`` of the graph of pairs above the threshold, pairs never listed.

    Each task resolves its own two cells and returns one edge per row to the smallest row
    it is connected to; joining those edges gives the same components as all the pairs.
    """
    _checked(threshold)
    with steps(df.sparkSession) as scope:
        units = durable(normalized(df, id_col, vec_col))
        cells = build(_one_variant(units), cell_rows)
        near = joined(cells, cells.pairs(units.sparkSession, _within(math.acos(threshold))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.column(2).type.value_type
                for row in range(len(batch)):
                    left, a = unpacked(batch, row, 2, 3)
                    right, b = unpacked(batch, row, 4, 5)
                    hit = a @ b.T > threshold
                    ids = np.concatenate([left, right])
                    here = np.arange(len(ids))
                    x, y = here[: len(left)].copy(), here[len(left) :].copy()
                    if batch.column(0)[row] == batch.column(1)[row]:
                        y = x.copy()
                    while True:
                        seen_y = np.minimum(y, np.where(hit, x[:, None], len(ids)).min(axis=0))
                        seen_x = np.minimum(x, np.where(hit, seen_y[None, :], len(ids)).min(axis=1))
                        if np.array_equal(seen_x, x) and np.array_equal(seen_y, y):
                            break
                        x, y = seen_x, seen_y
                    label = np.concatenate([x, y])
                    tied = label != here
                    yield pa.record_batch([pa.array(ids[label[tied]], kind), pa.array(ids[tied], kind)], ["src", "dst"])

        edges = near.mapInArrow(run, f"src {cells.id_type}, dst {cells.id_type}")
        return scope.keep(connected_components(edges.distinct()))


def pair_cosine(pairs: DataFrame, df: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """``cosine`` for the given ``id1, id2``; pairs without both vectors drop out."""
    units = normalized(df, id_col, vec_col)
    pairs = durable(pairs)
    for side in ("1", "2"):
        uses = pairs.groupBy(f"id{side}").agg(F.count(F.lit(1)).alias("_n"))
        side_vec = units.select(F.col("id").alias(f"id{side}"), F.col("vec").alias(f"_v{side}"))
        pairs = lookup(pairs, side_vec.join(uses, f"id{side}"), [f"id{side}"], "_n")
    return pairs.withColumn("cosine", dot(F.col("_v1"), F.col("_v2"))).drop("_v1", "_v2")


def active_pairs(
    df: DataFrame, phrases: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec"
) -> DataFrame:
    """``similar_pairs`` among rows whose phrase is not omitted."""
    active = df.join(
        phrases.filter(~F.coalesce("omit", F.lit(False))).select(F.col("kid").alias(id_col)), id_col, "left_semi"
    )
    if len(active.select(id_col).take(2)) < 2:
        raise ValueError("fewer than 2 active phrases remain")
    return similar_pairs(active, threshold, id_col, vec_col)


def _numbered(df: DataFrame, by: list[str], prefixes: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """``_v, id, vec`` with unit vectors, and the table of variants ``_v, *by`` (and ``m``)."""
    spark = df.sparkSession
    if by:
        schema = df.select(*by).schema
        seen = sorted(tuple(r) for r in df.select(*by).distinct().collect())
        names = spark.createDataFrame([(v, *x) for v, x in enumerate(seen)], f"_w int, {_fields(schema)}")
        df = df.join(F.broadcast(names), by)
    else:
        names = spark.createDataFrame([(0,)], "_w int")
        df = df.withColumn("_w", F.lit(0))
    sizes = list(prefixes or [0])
    parts = [
        df.select(
            (F.col("_w") * len(sizes) + i).alias("_v"),
            "id",
            l2_unit(F.slice("vec", 1, m) if m else F.col("vec")).alias("vec"),
        )
        for i, m in enumerate(sizes)
    ]
    units = parts[0]
    for part in parts[1:]:
        units = units.unionByName(part)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(m).alias("m")) for i, m in enumerate(sizes)]))
    names = names.withColumn("_s", each).select((F.col("_w") * len(sizes) + F.col("_s._i")).alias("_v"), *by, "_s.m")
    return units, names


def _fields(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _merged(best: np.ndarray, names: np.ndarray, cosines: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first columns of both tables by cosine, ties by the smaller id; as wide as ``best``."""
    all_cosines, all_names = np.hstack([best, cosines]), np.hstack([names, others])
    place = all_names
    if all_names.dtype == object:
        place = np.unique(all_names, return_inverse=True)[1].reshape(all_names.shape)
    order = np.lexsort((place, -all_cosines), axis=1)[:, : best.shape[1]]
    return np.take_along_axis(all_cosines, order, axis=1), np.take_along_axis(all_names, order, axis=1)


def _best_in(cells: Cells, pairs: DataFrame, wanted: int, bars: DataFrame | None) -> DataFrame:
    """``p, id, nn, cosine``: for the rows of ``p``, their best ``wanted`` rows of the cells chosen for it.

    ``bars`` (``p, held, bar``) gives the cosine that a row's neighbours must reach to matter. Of cells that follow
    each other for one ``p`` only the best together are returned, so a task returns ``wanted`` rows for a row of ``p``.
    """
    near = joined(cells, pairs, bars)
    barred = bars is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        ids = best = names = floor = kind = None

        def found() -> pa.RecordBatch:
            ok = np.isfinite(best).ravel()
            columns = [pa.array(np.full(int(ok.sum()), now)), pa.array(np.repeat(ids, wanted)[ok], kind)]
            columns += [pa.array(names.ravel()[ok], kind), pa.array(best.ravel()[ok])]
            return pa.record_batch(columns, ["p", "id", "nn", "cosine"])

        for batch in batches:
            kind = batch.column(2).type.value_type
            for row in range(len(batch)):
                p = batch.column(0)[row].as_py()
                mine, a = unpacked(batch, row, 2, 3)
                others, b = unpacked(batch, row, 4, 5)
                if p != now:
                    if now is not None:
                        yield found()
                    now, ids = p, mine
                    best = np.full((len(ids), wanted), -np.inf)
                    names = np.repeat(ids[:, None], wanted, axis=1)
                    floor = np.full(len(ids), -np.inf)
                    if barred:
                        held = batch.column(6)[row].values.to_numpy(zero_copy_only=False)
                        bar = batch.column(7)[row].values.to_numpy(zero_copy_only=False)
                        floor = bar[np.searchsorted(held, ids)]
                sims = np.round(a @ b.T, 9)
                if batch.column(1)[row].as_py() == p:
                    np.fill_diagonal(sims, -np.inf)
                least = np.maximum(floor, best[:, -1])
                some = np.flatnonzero(sims.max(axis=1) >= least)
                if not len(some):
                    continue
                sims = sims[some]
                sims[sims < least[some][:, None]] = -np.inf
                # Ids ascend within a cell, so a stable sort breaks ties by the smaller id.
                order = np.argsort(-sims, axis=1, kind="stable")[:, :wanted]
                best[some], names[some] = _merged(best[some], names[some], np.take_along_axis(sims, order, axis=1), others[order])
        if now is not None:
            yield found()

    return near.mapInArrow(run, f"p long, id {cells.id_type}, nn {cells.id_type}, cosine double")


#: Cells searched first besides a row's own; they set the bar for all others.
FIRST_CELLS = 2


def _closest(cells: Cells, wanted: int) -> tuple[DataFrame, int]:
    """``p, id, nn, cosine, rank`` of the best ``wanted`` per row, and the number of ordered pairs of cells searched.

    1. A row meets its own cell and the ``FIRST_CELLS`` with the smallest bounds; its ``wanted``-th best
       cosine so far is its bar.
    2. A cell is visited only if a row in it could still beat the lowest bar of the cell that asks, and
       then only cosines at or above a row's own bar come back.
    """
    spark = cells.packed.sparkSession
    place = Window.partitionBy("p", "id").orderBy(F.desc("cosine"), "nn")

    def first(i: int, others: np.ndarray, least: np.ndarray) -> np.ndarray:
        return others[np.lexsort((others, least, others != i))][: FIRST_CELLS + 1]

    opening = cells.pairs(spark, first)
    found = _best_in(cells, opening, wanted, None)
    found = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= wanted)
    if len(cells.cell) <= FIRST_CELLS + 1:
        # The opening has met every cell.
        return found, n_pairs(opening)
    found = durable(found)
    bar = F.when(F.count(F.lit(1)) >= wanted, F.min("cosine")).otherwise(F.lit(-2.0))
    reached = found.groupBy("p", "id").agg(bar.alias("bar"))
    every = cells.packed.select(F.col("cell").alias("p"), F.explode("ids").alias("id"))
    reached = every.join(reached, ["p", "id"], "left").fillna(-2.0, ["bar"])
    sorted_bars = F.array_sort(F.collect_list(F.struct("id", "bar")))
    bars = reached.groupBy("p").agg(F.min("bar").alias("lowest"), sorted_bars.alias("_b"))
    bars = durable(bars.select("p", "lowest", F.col("_b.id").alias("held"), F.col("_b.bar").alias("bar")))
    lowest = {r["p"]: r["lowest"] for r in bars.select("p", "lowest").toLocalIterator()}
    # Cosines are compared after rounding to nine places.
    widest = np.array([math.acos(max(-1.0, min(1.0, lowest[c] - 1e-9))) for c in cells.cell.tolist()])

    def rest(i: int, others: np.ndarray, least: np.ndarray) -> np.ndarray:
        return np.setdiff1d(others[least <= widest[i] + 1e-9], first(i, others, least))

    later = cells.pairs(spark, rest)
    more = _best_in(cells, later, wanted, bars.drop("lowest"))
    both = found.drop("rank").unionByName(more)
    ranked = both.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= wanted)
    return ranked, n_pairs(opening) + n_pairs(later)


def nearest(
    df: DataFrame,
    k: int,
    by: list[str] | None = None,
    id_col: str = "id",
    vec_col: str = "vec",
    cell_rows: int = CELL_ROWS,
    skip_first: bool = False,
    prefixes: list[int] | None = None,
) -> DataFrame:
    """``id, nn, cosine, rank``: the exact k nearest other rows on the unit sphere.

    On unit vectors the order by distance is the order by cosine; ties go to the smaller
    id. ``by`` runs several variants of the table in one job; ``prefixes`` repeats the search
    on the first m coordinates for each m (column ``m``). ``skip_first`` leaves the closest
    neighbour out and returns the k after it.
    """
    by = list(by or [])
    wanted = k + 1 if skip_first else k
    with steps(df.sparkSession) as scope:
        doubles = df.select(*by, F.col(id_col).alias("id"), as_doubles(F.col(vec_col)).alias("vec"))
        units, names = _numbered(doubles, by, prefixes)
        cells = build(durable(units), cell_rows)
        ranked, _ = _closest(cells, wanted)
        variant = F.expr(f"p div {VARIANT_CELLS}L").cast("int")
        ranked = ranked.withColumn("_v", variant).join(F.broadcast(names), "_v")
        if skip_first:
            ranked = ranked.filter("rank > 1").withColumn("rank", F.col("rank") - 1)
        return scope.keep(ranked.select(*by, *(["m"] if prefixes else []), "id", "nn", "cosine", "rank"))


def cells_searched(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", cell_rows: int = CELL_ROWS) -> tuple[int, int]:
    """Ordered pairs of cells that a search for the ``k`` nearest joins, and how many there are."""
    with steps(df.sparkSession):
        cells = build(durable(_one_variant(normalized(df, id_col, vec_col))), cell_rows)
        return _closest(cells, k)[1], len(cells.cell) ** 2


def cells_joined(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec", cell_rows: int = CELL_ROWS) -> tuple[int, int]:
    """Pairs of cells that the join at ``threshold`` looks at, and how many there are."""
    with steps(df.sparkSession):
        cells = build(durable(_one_variant(normalized(df, id_col, vec_col))), cell_rows)
        n = len(cells.cell)
        return n_pairs(cells.pairs(df.sparkSession, _within(math.acos(_checked(threshold))))), n * (n + 1) // 2


def hub_counts(first: DataFrame, ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``id, hits``: how often each id is the nearest neighbour of another; zeros kept."""
    by = list(by or [])
    hits = first.filter("rank = 1").groupBy(*by, F.col("nn").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return ids.select(*by, "id").join(hits, [*by, "id"], "left").fillna(0, ["hits"])


def hub_summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``hub_mean, hub_p95, hub_max``; values are counted first, so the quantile is exact and small."""
    by = list(by or [])
    per_value = counts.groupBy(*by, "hits").agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*by).agg(
        (F.sum(F.col("hits") * F.col("_n")) / F.sum("_n")).alias("hub_mean"),
        F.percentile("hits", F.lit(0.95), F.col("_n")).alias("hub_p95"),
        F.max("hits").alias("hub_max"),
    )


def neighbor_overlap(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``id, jaccard`` of the neighbour sets in ``a`` (baseline) and ``b`` (per ``by`` variant)."""
    by = list(by or [])
    base = a.select("id", "nn").withColumn("_in_a", F.lit(1))
    both = b.select(*by, "id", "nn").join(base, ["id", "nn"], "left")
    per_b = both.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("_nb"), F.count("_in_a").alias("_common"))
    per_a = base.groupBy("id").agg(F.count(F.lit(1)).alias("_na"))
    joined = per_a.join(per_b, "id", "left" if not by else "inner")
    common, size_b = F.coalesce("_common", F.lit(0)), F.coalesce("_nb", F.lit(0))
    return joined.select(*by, "id", (common / (F.col("_na") + size_b - common)).alias("jaccard"))


def overlap_summary(overlap: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and median overlap; the few distinct values are counted first."""
    by = list(by or [])
    per_value = overlap.groupBy(*by, "jaccard").agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*by).agg(
        (F.sum(F.col("jaccard") * F.col("_n")) / F.sum("_n")).alias("jaccard_mean"),
        F.percentile("jaccard", F.lit(0.5), F.col("_n")).alias("jaccard_median"),
    )


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A fixed random sample of at most ``n`` rows, chosen by a hash of seed and id."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    chosen = df.select(id_col).orderBy(key, id_col).limit(n)
    return df.join(chosen, id_col, "left_semi")


def align(ids: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Vectors of exactly the given ids; an error names up to five that have none."""
    missing = ids.join(vectors, id_col, "left_anti").select(id_col)
    n_missing = missing.count()
    if n_missing:
        examples = [str(r[0]) for r in missing.orderBy(id_col).take(5)]
        raise ValueError(f"no vector for {n_missing} ids (e.g. {', '.join(examples)})")
    return vectors.join(ids.select(id_col), id_col, "left_semi")


def missing_vectors(ids: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    return ids.join(vectors, id_col, "left_anti").select(id_col)
