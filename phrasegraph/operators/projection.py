"""Principal components of dense vectors and the diagnostics built on them.

The covariance is reduced across the cluster; only D x D numbers (D = vector length, up to
a few thousand) reach the driver. Tables with one row per component are small by definition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.dense import as_doubles, dot, l2_unit
from ..functions.text import char_count, word_count
from ..plans.durable import durable
from ..plans.ordering import with_average_rank
from .similarity import hub_counts, hub_summary, nearest, neighbor_overlap, overlap_summary, sample_rows

MAX_DIMS = 4096
#: Numbers of components that are tried.
KEEP_GRID = (8, 12, 16, 20, 24, 32, 40, 50, 64, 80, 96, 128, 160, 200, 256, 320, 384, 512)


def column_moments(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """One row: ``mean, sd, n`` with per-dimension mean and sample standard deviation."""
    stats = Summarizer.metrics("mean", "std", "count").summary(array_to_vector(as_doubles(F.col(vec_col))))
    return df.agg(stats.alias("_s")).select(
        vector_to_array("_s.mean").alias("mean"),
        vector_to_array("_s.std").alias("sd"),
        F.col("_s.count").alias("n"),
    )


def centered(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Subtract the column means (a one-row table)."""
    means = column_moments(df, vec_col).select(F.col("mean").alias("_mean"))
    return df.join(F.broadcast(means)).withColumn(
        vec_col, F.zip_with(as_doubles(F.col(vec_col)), "_mean", lambda x, m: x - m)
    ).drop("_mean")


def standardize(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Mean 0 and sample standard deviation 1 per dimension; a constant dimension becomes 0."""
    moments = column_moments(df, vec_col).select(
        F.col("mean").alias("_mean"),
        F.transform("sd", lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)).alias("_sd"),
    )
    shifted = df.join(F.broadcast(moments)).withColumn(
        vec_col, F.zip_with(as_doubles(F.col(vec_col)), "_mean", lambda x, m: x - m)
    )
    return shifted.withColumn(vec_col, F.zip_with(vec_col, "_sd", lambda x, s: x / s)).drop("_mean", "_sd")


def covariance(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """``i, j, cov`` for i <= j (1-based): the centred sample covariance.

    Every task adds up its own rows; only D partial rows per task are shuffled.
    """
    rows = centered(df, vec_col).select(vec_col)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vec_col].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(1, len(total) + 1), "row": list(total), "n": n})

    summed = (
        rows.mapInPandas(partial, "i int, row array<double>, n long")
        .groupBy("i")
        .agg(Summarizer.sum(array_to_vector("row")).alias("_v"), F.sum("n").alias("_n"))
        .select("i", "_n", F.posexplode(vector_to_array("_v")).alias("_j", "_c"))
    )
    return summed.filter(F.col("_j") + 1 >= F.col("i")).select(
        "i", (F.col("_j") + 1).alias("j"), (F.col("_c") / (F.col("_n") - 1)).alias("cov")
    )


@dataclass
class Projection:
    """Fitted components: ``loadings`` is D x k, ``evr`` the explained variance ratios."""

    mean: np.ndarray
    loadings: np.ndarray
    evr: np.ndarray
    n_rows: int

    def components(self, df: DataFrame) -> DataFrame:
        """``component, dim, loading``."""
        d, k = self.loadings.shape
        rows = [(c + 1, i + 1, float(self.loadings[i, c])) for c in range(k) for i in range(d)]
        return df.sparkSession.createDataFrame(rows, "component int, dim int, loading double")

    def spectrum(self, df: DataFrame) -> DataFrame:
        """``m, evr``, one row per component."""
        rows = [(m + 1, float(v)) for m, v in enumerate(self.evr)]
        return df.sparkSession.createDataFrame(rows, "m int, evr double")


def fit_pca(df: DataFrame, k: int | None = None, vec_col: str = "vec") -> Projection:
    """Centre-only principal components; the largest loading of each is made positive."""
    moments = column_moments(df, vec_col).first()
    d = len(moments["mean"])
    if d > MAX_DIMS:
        raise ValueError(f"principal components are limited to {MAX_DIMS} dimensions, got {d}")
    k = min(k or d, d)
    rows = df.select(array_to_vector(as_doubles(F.col(vec_col))).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    signs[signs == 0] = 1.0
    return Projection(np.array(moments["mean"]), loadings * signs, model.explainedVariance.toArray(), moments["n"])


def _matrix_udf(mean: np.ndarray, apply):
    def run(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        return pd.Series(list(apply(np.stack(vec.to_numpy()) - mean)))

    return F.pandas_udf(run, ArrayType(DoubleType()))


def pc_scores(df: DataFrame, fit: Projection, k: int | None = None, vec_col: str = "vec") -> DataFrame:
    """Replace the vector by its scores on the first ``k`` components."""
    axes = fit.loadings[:, : k or fit.loadings.shape[1]]
    scores = _matrix_udf(fit.mean, lambda x: x @ axes)
    return df.withColumn(vec_col, scores(as_doubles(F.col(vec_col))))


def reduce_dims(df: DataFrame, target: int = 200, vec_col: str = "vec") -> DataFrame:
    """Scores on ``target`` components, or the input itself if it has no more dimensions."""
    first = df.select(F.size(vec_col).alias("d")).first()
    if first is None or first["d"] <= target:
        return df
    return pc_scores(df, fit_pca(df, target, vec_col), target, vec_col)


def remove_top_pcs(df: DataFrame, fit: Projection, r: int, vec_col: str = "vec") -> DataFrame:
    """Centre, subtract the projection on the first ``r`` components, renormalise.

    ``r = 0`` keeps the vectors as they are, only renormalised.
    """
    if r == 0:
        return df.withColumn(vec_col, l2_unit(as_doubles(F.col(vec_col))))
    axes = fit.loadings[:, :r]
    rest = _matrix_udf(fit.mean, lambda x: x - (x @ axes) @ axes.T)
    return df.withColumn(vec_col, rest(as_doubles(F.col(vec_col)))).withColumn(vec_col, l2_unit(F.col(vec_col)))


# -- choosing the number of components ------------------------------------------------------


def cumulative(spectrum: DataFrame) -> DataFrame:
    """Add ``cum_evr``. The table has one row per component, so one window task is enough."""
    upto = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.withColumn("cum_evr", F.sum("evr").over(upto))


def evr_targets(spectrum: DataFrame, targets: tuple[float, ...] = (0.90, 0.95, 0.99)) -> DataFrame:
    """``target, m``: the smallest m whose cumulative share reaches the target (null if none)."""
    cum = cumulative(spectrum)
    found = [F.min(F.when(F.col("cum_evr") >= t, F.col("m"))) for t in targets]
    return cum.agg(
        F.array(*[F.struct(F.lit(t).alias("target"), m.alias("m")) for t, m in zip(targets, found)]).alias("_r")
    ).select(F.inline("_r"))


def signal_count(spectrum: DataFrame, n_rows: int) -> DataFrame:
    """``n_signal``: eigenvalues above the Marchenko-Pastur edge, median eigenvalue as scale.

    The rule is scale free, so variance shares do. Only min(N, D) values are used.
    """
    d = spectrum.count()
    edge = (1 + (d / (n_rows - 1)) ** 0.5) ** 2
    kept = spectrum.filter(F.col("m") <= min(n_rows, d))
    mid = kept.agg(F.median("evr").alias("_mid"))
    return kept.join(F.broadcast(mid)).agg(
        F.count_if(F.col("evr") > F.col("_mid") * F.lit(edge)).alias("n_signal")
    )


def knee_index(spectrum: DataFrame) -> DataFrame:
    """``m_knee``: where the cumulative share is farthest from its chord (smallest on ties)."""
    cum = cumulative(spectrum)
    ends = cum.agg(
        F.min_by("cum_evr", "m").alias("_y1"), F.max_by("cum_evr", "m").alias("_y2"), F.max("m").alias("_x2")
    )
    dy, dx = F.col("_y2") - F.col("_y1"), F.col("_x2") - 1
    gap = F.abs(dy * F.col("m") - dx * F.col("cum_evr") + F.col("_x2") * F.col("_y1") - F.col("_y2"))
    distance = F.round(gap / F.sqrt(dy * dy + dx * dx), 12)
    return cum.join(F.broadcast(ends)).agg(
        F.max_by("m", F.struct(distance, -F.col("m"))).alias("m_knee")
    )


def choose_m(overlaps: DataFrame, n_signal: DataFrame, knee: DataFrame) -> DataFrame:
    """``m_j90, m_j80, n_signal, m_knee, m_chosen``; missing values are ignored in the maximum."""
    reached = overlaps.agg(
        F.min(F.when(F.col("jaccard_mean") >= 0.90, F.col("m"))).alias("m_j90"),
        F.min(F.when(F.col("jaccard_mean") >= 0.80, F.col("m"))).alias("m_j80"),
    )
    return (
        reached.join(F.broadcast(n_signal))
        .join(F.broadcast(knee))
        .withColumn("m_chosen", F.greatest("n_signal", "m_knee", "m_j90"))
    )


# -- genericity and neighbourhood studies ------------------------------------------------------


def centroid_similarity(df: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """``id, centroid_sim``: dot product with the normalised mean vector."""
    mean = column_moments(df, vec_col).select(l2_unit(F.col("mean")).alias("_mu"))
    return df.join(F.broadcast(mean)).select(
        id_col, dot(as_doubles(F.col(vec_col)), F.col("_mu")).alias("centroid_sim")
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, spearman`` over complete cases, ties sharing their mean rank."""
    clean = durable(df.select(x, y).dropna())
    ranked = with_average_rank(with_average_rank(clean, x, "_rx"), y, "_ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def _first_score(col: Column) -> Column:
    return F.get(col, F.lit(0))


def genericity(df: DataFrame, fit: Projection, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """``id, pc1, centroid_sim``."""
    one = pc_scores(df, fit, 1, vec_col).select(id_col, _first_score(F.col(vec_col)).alias("pc1"))
    return one.join(centroid_similarity(df, id_col, vec_col), id_col)


def axis_correlations(scores: DataFrame, against: list[str], axis: str = "pc1") -> DataFrame:
    """``name, n, spearman``: rank correlation of ``axis`` with each of the columns, over complete pairs."""
    found = None
    for name in against:
        one = spearman(scores, axis, name).select(F.lit(name).alias("name"), "n", "spearman")
        found = one if found is None else found.unionByName(one)
    return found


def pc1_correlations(
    df: DataFrame,
    fit: Projection,
    texts: DataFrame | None = None,
    id_col: str = "id",
    vec_col: str = "vec",
    text_col: str = "text",
) -> DataFrame:
    """``name, n, spearman`` of the first component's scores with ``centroid_sim`` and, given ``texts``
    (``id, text``), with ``n_tokens`` (runs without white space) and ``n_chars``. Vectors without a text count
    for the first only.
    """
    scores = genericity(df, fit, id_col, vec_col)
    against = ["centroid_sim"]
    if texts is not None:
        lengths = texts.select(id_col, word_count(F.col(text_col)).alias("n_tokens"), char_count(F.col(text_col)).alias("n_chars"))
        scores = scores.join(lengths, id_col, "left")
        against += ["n_tokens", "n_chars"]
    return axis_correlations(durable(scores), against)


def removal_sweep(df: DataFrame, r_max: int = 4, k: int = 10, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Per number ``r`` of removed components: hub and neighbour-overlap summary against r = 0.

    All variants run as one nearest-neighbour job. ``df`` is ``id, vec``.
    """
    df = durable(df)
    fit = fit_pca(df, r_max)
    kept = df if sample is None else sample_rows(df, sample, seed)
    variants = None
    for r in range(r_max + 1):
        one = remove_top_pcs(kept, fit, r).select(F.lit(r).alias("r"), "id", "vec")
        variants = one if variants is None else variants.unionByName(one)
    variants = durable(variants)
    found = durable(nearest(variants, k, by=["r"]))
    hubs = hub_summary(hub_counts(found, variants.select("r", "id"), ["r"]), ["r"])
    base = found.filter("r = 0").drop("r")
    overlap = overlap_summary(neighbor_overlap(base, found, ["r"]), ["r"])
    return hubs.join(overlap, "r")


def keep_sweep(
    df: DataFrame, grid: tuple[int, ...] = KEEP_GRID, k: int = 10, sample: int | None = None, seed: int = 42
) -> tuple[DataFrame, Projection]:
    """``m, jaccard_mean, jaccard_median``: overlap with the full space when m components are kept."""
    df = durable(df)
    fit = fit_pca(df)
    d = fit.loadings.shape[0]
    sizes = sorted({min(m, d) for m in grid} | {d})
    kept = df if sample is None else durable(sample_rows(df, sample, seed))
    base = durable(nearest(kept, k))
    found = nearest(pc_scores(kept, fit), k, prefixes=sizes)
    return overlap_summary(neighbor_overlap(base, found, ["m"]), ["m"]), fit
