"""Split diagnostics and model-quality metrics over labelled pairs ``kw1, kw2, value, fold``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_array
from ..plans.durable import durable
from ..plans.ordering import exact_quantiles, with_average_rank
from ..plans.skew import lookup
from .checks import require_columns, require_rows
from .sampling import pair_key
from .similarity import pair_cosine

#: Folds of the cross-validation and held out, words of a long pair, bins of the labels.
CV_FOLDS = (1, 2, 3, 4)
HOLDOUT_FOLD = 5
LONG_PAIR_TOKENS = 12
LABEL_BINS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Rows with both phrases and a value in [0, 1]; the fold is an integer."""
    require_columns(pairs, ["kw1", "kw2", "fold", "value"], "pairs with folds")
    kept = pairs.dropna(subset=["kw1", "kw2", "value"]).filter(F.col("value").between(0.0, 1.0))
    return kept.withColumn("fold", F.col("fold").cast("int"))


def cv_rows(pairs: DataFrame, folds: Sequence[int] = CV_FOLDS) -> DataFrame:
    return pairs.filter(F.col("fold").isin(list(folds)))


def holdout_rows(pairs: DataFrame, fold: int = HOLDOUT_FOLD) -> DataFrame:
    return pairs.filter(F.col("fold") == fold)


def fold_moments(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("label_mean"),
        F.stddev_samp("value").alias("label_std"),
    )


def right_closed_bin(col: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """1-based number of the bin (lo, hi] that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for number in range(len(edges) - 1, 0, -1):
        inside = (col > edges[number - 1]) & (col <= edges[number])
        if include_lowest and number == 1:
            inside = (col >= edges[0]) & (col <= edges[1])
        out = F.when(inside, number).otherwise(out)
    return out


def label_histogram(pairs: DataFrame, edges: Sequence[float] = LABEL_BINS) -> DataFrame:
    """Row shares ``bin_1 .. bin_B`` per fold; values outside every bin do not count."""
    binned = pairs.select("fold", right_closed_bin(F.col("value"), edges).alias("bin")).dropna()
    numbers = range(1, len(edges))
    return binned.groupBy("fold").agg(
        *[(F.count_if(F.col("bin") == b) / F.count(F.lit(1))).alias(f"bin_{b}") for b in numbers]
    )


def cross_fold_leaks(pairs: DataFrame) -> DataFrame:
    """``pair, fold, n`` of unordered pairs that occur in more than one fold."""
    counts = pairs.groupBy(pair_key(F.col("kw1"), F.col("kw2")).alias("pair"), "fold").agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most one row per fold is left per pair, so the groups below are tiny.
    leaking = counts.groupBy("pair").agg(F.count(F.lit(1)).alias("_f")).filter("_f > 1").select("pair")
    return counts.join(leaking, "pair", "left_semi")


def _token_lengths(pairs: DataFrame) -> DataFrame:
    first, second = F.size(word_array(F.col("kw1"))), F.size(word_array(F.col("kw2")))
    return pairs.select("fold", first.alias("kw1"), second.alias("kw2"), (first + second).alias("pair"))


def token_length_stats(pairs: DataFrame) -> DataFrame:
    """Count, mean, sd and five-number summary of token counts per fold and side.

    Equal lengths are counted first, so a group holds one row per distinct length.
    """
    sides = F.inline(
        F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("len")) for s in ("kw1", "kw2", "pair")])
    )
    counts = _token_lengths(pairs).select("fold", sides).groupBy("fold", "side", "len").agg(
        F.count(F.lit(1)).alias("_n")
    )
    n = F.sum("_n")
    mean = F.sum(F.col("len") * F.col("_n")) / n
    spread = F.sum(F.col("len") * F.col("len") * F.col("_n")) - n * mean * mean
    quartiles = [
        F.percentile("len", F.lit(p), F.col("_n")).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ]
    return counts.groupBy("fold", "side").agg(
        n.alias("n"),
        mean.alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("sd"),
        F.min("len").alias("min"),
        *quartiles,
        F.max("len").alias("max"),
    )


def long_pair_share(pairs: DataFrame, limit: int = LONG_PAIR_TOKENS) -> DataFrame:
    long_pair = (F.col("pair") > limit).cast("double")
    return _token_lengths(pairs).groupBy("fold").agg(F.avg(long_pair).alias("long_share"))


def rare_token_score(pairs: DataFrame) -> DataFrame:
    """Per fold: mean over its token occurrences of 1 / max(1, frequency in the other folds)."""
    words = F.concat(word_array(F.col("kw1")), word_array(F.col("kw2")))
    own = pairs.select("fold", F.explode(words).alias("token")).groupBy("fold", "token").agg(
        F.count(F.lit(1)).alias("_own")
    )
    total = own.groupBy("token").agg(F.sum("_own").alias("_all"))
    other = F.greatest(F.lit(1), F.col("_all") - F.col("_own"))
    return own.join(total, "token").groupBy("fold").agg(
        (F.sum(F.col("_own") / other) / F.sum("_own")).alias("rare_score")
    )


def cv_frames(pairs: DataFrame, folds: Sequence[int] = CV_FOLDS) -> DataFrame:
    """Every cross-validation row once per run ``val_fold``, flagged ``is_val``.

    The list of folds is fixed and short, so rows multiply by its length only.
    """
    runs = F.explode(F.array(*[F.lit(int(f)) for f in folds])).alias("val_fold")
    return cv_rows(pairs, folds).select("*", runs).withColumn("is_val", F.col("fold") == F.col("val_fold"))


def cv_sizes(pairs: DataFrame, folds: Sequence[int] = CV_FOLDS) -> DataFrame:
    """``val_fold, n_train, n_val``."""
    return cv_frames(pairs, folds).groupBy("val_fold").agg(
        F.count_if(~F.col("is_val")).alias("n_train"), F.count_if("is_val").alias("n_val")
    )


def require_cv(pairs: DataFrame, folds: Sequence[int] = CV_FOLDS) -> DataFrame:
    """The frames of ``cv_frames``; an error if a run has an empty side."""
    sizes = {r["val_fold"]: (r["n_train"], r["n_val"]) for r in cv_sizes(pairs, folds).collect()}
    bad = [f for f in folds if 0 in sizes.get(f, (0, 0))]
    if bad:
        raise ValueError(f"folds {bad}: empty training or validation side")
    return cv_frames(pairs, folds)


def score_pairs(pairs: DataFrame, vectors: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """``kw1, kw2, value, pred, error`` from the cosine of the two phrases' vectors."""
    ends = require_rows(pairs, "pairs to score").withColumnRenamed("kw1", "id1").withColumnRenamed("kw2", "id2")
    scored = pair_cosine(ends, vectors, phrase_col).withColumnRenamed("cosine", "pred")
    return scored.withColumn("error", F.col("pred") - F.col("value")).select(
        F.col("id1").alias("kw1"), F.col("id2").alias("kw2"), "value", "pred", "error"
    )


def metrics(scored: DataFrame) -> DataFrame:
    """One row: n, Spearman, Pearson, MAE, RMSE and bias of ``pred`` against ``value``."""
    scored = durable(scored.select("value", "pred"))
    ranked = with_average_rank(with_average_rank(scored, "value", "_rv"), "pred", "_rp")
    error = F.col("pred") - F.col("value")
    return ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("_rp", "_rv").alias("spearman"),
        F.corr("pred", "value").alias("pearson"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
    )


def fold_spearman(scored: DataFrame) -> DataFrame:
    """``fold, spearman`` with ranks taken inside each fold."""
    scored = durable(scored.select("fold", "value", "pred"))
    ranked = with_average_rank(with_average_rank(scored, "value", "_rv", ["fold"]), "pred", "_rp", ["fold"])
    return ranked.groupBy("fold").agg(F.corr("_rp", "_rv").alias("spearman"))


def cv_score(per_fold: DataFrame) -> DataFrame:
    """Mean and population standard deviation over folds (0 for a single fold)."""
    return per_fold.agg(
        F.avg("spearman").alias("cv_mean"), F.coalesce(F.stddev_pop("spearman"), F.lit(0.0)).alias("cv_std")
    )


def fold_difficulty(runs: DataFrame) -> DataFrame:
    """Mean and population standard deviation per fold over many runs ``run, fold, spearman``."""
    return runs.groupBy("fold").agg(
        F.avg("spearman").alias("mean"), F.stddev_pop("spearman").alias("std")
    )


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per true-value quantile bin: ``bin, lo, hi, n, true_mean, pred_mean, mae``.

    Repeated quantile edges collapse. The edges are ``bins + 1`` numbers.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = sorted({r["value"] for r in exact_quantiles(scored, "value", probs).collect()})
    if len(edges) < 2:
        raise ValueError("calibration needs at least two distinct edges")
    number = right_closed_bin(F.col("value"), edges, include_lowest=True)
    binned = scored.withColumn("bin", number)
    out = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("true_mean"),
        F.avg("pred").alias("pred_mean"),
        F.avg(F.abs(F.col("pred") - F.col("value"))).alias("mae"),
    )
    lo = F.array(*[F.lit(float(e)) for e in edges])
    return out.select(
        "bin", F.get(lo, F.col("bin") - 1).alias("lo"), F.get(lo, F.col("bin")).alias("hi"),
        "n", "true_mean", "pred_mean", "mae",
    )


def metrics_record(measured: DataFrame, **settings: str | int | float) -> DataFrame:
    """The metrics row with run settings and a time stamp, ready for JSON."""
    fixed = [F.lit(v).alias(k) for k, v in settings.items()]
    return measured.select("*", *fixed, F.current_timestamp().alias("timestamp"))
