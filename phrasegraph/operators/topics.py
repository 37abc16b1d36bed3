"""Sparse topic-model inputs and deterministic scoring of a fitted model.

Counts are triplets ``ii, jj, vv``. Model parameters are small dense matrices (topics times
features) given as DataFrames ``row, vec``; they are read once and their size is checked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.dense import as_doubles, dot, l2_unit
from ..plans.durable import durable
from ..plans.ordering import dense_index, running_total
from ..plans.skew import lookup
from .projection import reduce_dims, standardize
from .similarity import align

#: Model sizes and prior scales.
DEFAULTS = {
    "L": 40, "R": 8, "prefer_M": 200, "prefer_P": 200, "beta_scale": 0.5, "W_scale": 0.1, "Lambda_scale": 0.5,
}
MAX_PARAMETERS = 2_000_000

#: Lanczos coefficients (g = 7, n = 9) of the gamma function.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_factorial(n: Column) -> Column:
    """ln(n!) as a column expression; no table of factorials and no join is needed."""
    x = n.cast("double")
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + F.lit(c) / (x + i)
    t = x + 7.5
    value = F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(series)
    return F.when(n <= 1, F.lit(0.0)).otherwise(value)


# -- inputs -----------------------------------------------------------------------------------


def presence_triplets(
    phrases: DataFrame, postings: DataFrame, docs: DataFrame, use_omit: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ii, jj, vv`` (presence, 1-based) with the numberings ``doc_id, ii`` and ``kid, jj``.

    Documents are numbered in id order over the whole universe, phrases in id order.
    """
    if use_omit and "omit" in phrases.columns:
        phrases = phrases.filter(~F.coalesce("omit", F.lit(False)))
    doc_ids = durable(dense_index(docs.select("doc_id").distinct(), ["doc_id"], "ii"))
    kids = durable(dense_index(phrases.select("kid").distinct(), ["kid"], "jj"))
    pairs = durable(postings.select("kid", "doc_id").distinct())
    uses_k = pairs.groupBy("kid").agg(F.count(F.lit(1)).alias("_n"))
    uses_d = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup(lookup(pairs, kids.join(uses_k, "kid"), ["kid"], "_n"), doc_ids.join(uses_d, "doc_id"), ["doc_id"], "_n")
    return joined.select("ii", "jj", F.lit(1).alias("vv")), doc_ids, kids


def coalesce_triplets(triplets: DataFrame) -> DataFrame:
    """Duplicate cells summed after rounding; whoever writes them sorts."""
    rounded = triplets.select("ii", "jj", F.round("vv").cast("long").alias("vv"))
    return rounded.groupBy("ii", "jj").agg(F.sum("vv").alias("vv"))


def triplet_summary(triplets: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Sizes, density and the number of broken cells."""
    outside = ~(F.col("ii").between(1, n_docs) & F.col("jj").between(1, n_terms))
    return triplets.agg(
        F.lit(n_docs).cast("long").alias("D"),
        F.lit(n_terms).cast("long").alias("K"),
        F.count(F.lit(1)).alias("NNZ"),
        (F.count(F.lit(1)) / F.lit(float(n_docs) * n_terms)).alias("density"),
        F.count_if(F.col("vv") <= 0).alias("not_positive"),
        F.count_if(outside).alias("out_of_bounds"),
    )


def require_triplets(triplets: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    row = triplet_summary(triplets, n_docs, n_terms).first()
    if row["not_positive"] or row["out_of_bounds"]:
        raise ValueError(f"{row['not_positive']} non-positive and {row['out_of_bounds']} out-of-bounds cells")
    return triplets


def phrase_features(vectors: DataFrame, kids: DataFrame, target: int = DEFAULTS["prefer_M"]) -> DataFrame:
    """``id, vec``: projected to ``target`` components, unit length, exactly the given ids."""
    reduced = reduce_dims(vectors, target)
    return align(kids, reduced.withColumn("vec", l2_unit(as_doubles(F.col("vec")))))


def doc_features(vectors: DataFrame, docs: DataFrame, target: int = DEFAULTS["prefer_P"]) -> DataFrame:
    """``id, vec``: projected to ``target`` components, columns standardised, exactly the given ids."""
    return align(docs, standardize(reduce_dims(vectors, target)))


def row_pointers(triplets: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``ii, n_cells, row_ptr``: 1-based start of each document's cells in row order."""
    counts = triplets.groupBy("ii").agg(F.count(F.lit(1)).alias("n_cells"))
    every = doc_ids.select("ii").join(counts, "ii", "left").fillna(0, ["n_cells"])
    starts = running_total(every, ["ii"], "n_cells", "_before", inclusive=False)
    return starts.select("ii", "n_cells", (F.col("_before") + 1).alias("row_ptr"))


def multinomial_constants(triplets: DataFrame) -> DataFrame:
    """``ii, n_doc, log_const``: ln n! minus the sum of ln y! over the document's cells."""
    per_doc = triplets.groupBy("ii").agg(
        F.sum("vv").alias("n_doc"), F.sum(log_factorial(F.col("vv"))).alias("_cells")
    )
    return per_doc.select("ii", "n_doc", (log_factorial(F.col("n_doc")) - F.col("_cells")).alias("log_const"))


# -- scoring ------------------------------------------------------------------------------------


def parameter_matrix(rows: DataFrame) -> np.ndarray:
    """A parameter table ``row, vec`` as a matrix, rows in order; refuses to be large."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if (first["n"] or 0) * (first["d"] or 0) > MAX_PARAMETERS:
        raise ValueError(f"parameter table of {first['n']} x {first['d']} is too large")
    return np.array([r["vec"] for r in rows.orderBy("row").collect()], dtype=float)


def _rows_times(matrix: np.ndarray):
    def run(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vec.to_numpy()) @ matrix))

    return F.pandas_udf(run, ArrayType(DoubleType()))


def topic_phrases(features: DataFrame, b: DataFrame, kappa: float) -> DataFrame:
    """``id, phi``: per topic a softmax over all phrases of kappa E B.

    Maximum and sum are two partial aggregates with one row per topic.
    """
    matrix = parameter_matrix(b)
    logits = durable(features.select("id", (_rows_times(kappa * matrix)(as_doubles(F.col("vec")))).alias("a")))
    cells = logits.select(F.posexplode("a").alias("topic", "a"))
    tops = cells.groupBy("topic").agg(F.max("a").alias("_top"))
    sums = (
        cells.join(F.broadcast(tops), "topic")
        .groupBy("topic", "_top")
        .agg((F.col("_top") + F.log(F.sum(F.exp(F.col("a") - F.col("_top"))))).alias("_lse"))
    )
    # One number per topic.
    norm = sums.agg(F.array_sort(F.collect_list(F.struct("topic", "_lse"))).alias("_z")).select(
        F.col("_z._lse").alias("_z")
    )
    return logits.join(F.broadcast(norm)).select(
        "id", F.zip_with("a", "_z", lambda a, z: F.exp(a - z)).alias("phi")
    )


def softmax(vec: Column) -> Column:
    """Softmax of an array column; shifted by its maximum, which is evaluated once per row."""
    shifted = F.zip_with(vec, F.array_repeat(F.array_max(vec), F.size(vec)), lambda x, m: F.exp(x - m))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(shifted, F.array_repeat(total, F.size(vec)), lambda x, t: x / t)


def doc_topics(
    features: DataFrame, latent: DataFrame, w: DataFrame, b: DataFrame, loadings: DataFrame, sigma: DataFrame
) -> DataFrame:
    """``id, theta``: softmax(X W + b + Lambda z + sigma * eps), row by row.

    ``features`` is ``id, vec`` and ``latent`` is ``id, z, eps``. ``b`` and ``sigma`` are one-row tables.
    """
    weights, lam = parameter_matrix(w), parameter_matrix(loadings)
    shift, scale = parameter_matrix(b)[0], parameter_matrix(sigma)[0]

    def run(x: pd.Series, z: pd.Series, eps: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        x, z, eps = (np.stack(s.to_numpy()) for s in (x, z, eps))
        return pd.Series(list(x @ weights + shift + z @ lam.T + scale * eps))

    eta = F.pandas_udf(run, ArrayType(DoubleType()))
    both = features.select("id", as_doubles(F.col("vec")).alias("x")).join(latent, "id")
    scored = both.select("id", eta("x", "z", "eps").alias("eta"))
    return scored.select("id", softmax(F.col("eta")).alias("theta"))


def doc_log_likelihood(triplets: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """``ii, log_lik``: the constant plus the sum of y ln(phi . theta) over non-zero cells.

    ``phi`` is ``jj, phi`` and ``theta`` is ``ii, theta``. Busy phrases and documents are
    joined by broadcast of their rows.
    """
    triplets = durable(triplets)
    uses_j = triplets.groupBy("jj").agg(F.count(F.lit(1)).alias("_n"))
    uses_i = triplets.groupBy("ii").agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup(lookup(triplets, phi.join(uses_j, "jj"), ["jj"], "_n"), theta.join(uses_i, "ii"), ["ii"], "_n")
    cell = F.col("vv") * F.log(dot(F.col("phi"), F.col("theta")))
    sums = joined.groupBy("ii").agg(F.sum(cell).alias("_s"))
    return sums.join(multinomial_constants(triplets), "ii").select(
        "ii", (F.col("_s") + F.col("log_const")).alias("log_lik")
    )


def write_bundle(
    path: str, triplets: DataFrame, e: DataFrame, x: DataFrame, doc_ids: DataFrame, kids: DataFrame, **sizes: float
) -> DataFrame:
    """Write triplets, features, numberings and a one-row manifest below ``path``; returns the manifest.

    ``e`` and ``x`` are ``id, vec``; they are written as ``jj, vec`` and ``ii, vec`` by the numberings
    ``doc_id, ii`` and ``kid, jj``, so their rows match the triplets. An error if a number lacks its features.
    """
    settings = {**{k: v for k, v in DEFAULTS.items() if not k.startswith("prefer")}, **sizes}
    spark = triplets.sparkSession
    triplets.write.parquet(f"{path}/triplets")
    doc_ids.select("ii", "doc_id").write.parquet(f"{path}/documents")
    kids.select("jj", "kid").write.parquet(f"{path}/phrases")
    dims = {}
    for name, size, features, numbers, row, key in (
        ("E", "M", e, "phrases", "jj", "kid"),
        ("X", "P", x, "documents", "ii", "doc_id"),
    ):
        numbered = spark.read.parquet(f"{path}/{numbers}").withColumnRenamed(key, "id")
        numbered.join(features.select("id", "vec"), "id", "left").select(row, "vec").write.parquet(f"{path}/{name}")
        facts = spark.read.parquet(f"{path}/{name}").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("vec").alias("filled"),
            F.count_distinct(row).alias("numbers"),
            F.max(F.size("vec")).alias("width"),
        ).first()
        if not facts["rows"] == facts["filled"] == facts["numbers"]:
            raise ValueError(f"{name} needs exactly one vector per number: {facts.asDict()}")
        dims |= {("K" if name == "E" else "D"): facts["rows"], size: facts["width"]}
    manifest = spark.read.parquet(f"{path}/triplets").agg(F.count(F.lit(1)).alias("NNZ"))
    values = {k: dims[k] for k in ("D", "K", "M", "P")} | settings
    manifest = manifest.select("NNZ", *[F.lit(v).alias(k) for k, v in values.items()])
    manifest.write.json(f"{path}/manifest")
    return manifest
