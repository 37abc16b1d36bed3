"""Reproducible pair sampling for labelling, used-pair bookkeeping and phrase flags.

Every random choice is an order by ``md5(seed | key)``, so a sample can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import highlight, norm_rater, spaces_for_hyphens
from ..plans.durable import durable
from ..plans.ordering import dense_index
from ..plans.skew import SMALL_ROWS, lookup
from .graph import shared_documents
from .similarity import pair_cosine, similar_pairs

#: The samplers' default parameters.
DEFAULTS = {
    "n": 10, "target": 0.5, "tol": 0.05, "max_sim": 0.9, "min_shared": 1, "min_sim": 0.7, "max_shared": 0,
}
DRAWS_PER_PAIR = 50
FLAGS = ("omit", "method", "thematic")


def pair_key(a: Column, b: Column) -> Column:
    """Unordered key ``A||B``, smaller end first."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def hash_order(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def canonical_pairs(pairs: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """Smaller end first, self pairs dropped, each pair once."""
    return (
        pairs.filter(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"))
        .distinct()
    )


def used_pairs(labels: DataFrame, phrases: DataFrame) -> DataFrame:
    """``pair``: distinct keys of labelled pairs whose phrases are both known."""
    kids = phrases.select("phrase", "kid")
    uses1 = labels.groupBy(F.col("kw1").alias("kw1")).agg(F.count(F.lit(1)).alias("_n"))
    uses2 = labels.groupBy(F.col("kw2").alias("kw2")).agg(F.count(F.lit(1)).alias("_n"))
    first = kids.select(F.col("phrase").alias("kw1"), F.col("kid").alias("_a")).join(uses1, "kw1")
    second = kids.select(F.col("phrase").alias("kw2"), F.col("kid").alias("_b")).join(uses2, "kw2")
    joined = lookup(lookup(labels.select("kw1", "kw2"), first, ["kw1"], "_n"), second, ["kw2"], "_n")
    return joined.select(pair_key(F.col("_a"), F.col("_b")).alias("pair")).distinct()


def rater_pairs(labels: DataFrame, phrases: DataFrame, rater: str) -> DataFrame:
    """Used pairs of one rater; initials are compared in normal form."""
    mine = labels.filter(norm_rater(F.col("rater")) == norm_rater(F.lit(rater)))
    return used_pairs(mine.filter(F.col("kw1").isNotNull() & F.col("kw2").isNotNull()), phrases)


def exclude_used(pairs: DataFrame, used: DataFrame | None) -> DataFrame:
    """Drop pairs already labelled; no used set keeps all."""
    if used is None:
        return pairs
    keyed = pairs.withColumn("pair", pair_key(F.col("id1"), F.col("id2")))
    return keyed.join(used.select("pair"), "pair", "left_anti").drop("pair")


def _draw(col: Column, side: str, seed: int, n_ids: int) -> Column:
    """A uniform index 1..n_ids from the hash of (seed, draw, side)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), col.cast("string"), F.lit(side)))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(n_ids)) + 1


def _drawn_pairs(numbered: DataFrame, n_ids: int, n_draws: int, seed: int) -> DataFrame:
    """``id1, id2, draw``: the distinct pairs of the first ``n_draws`` draws and when each came first."""
    draws = numbered.sparkSession.range(1, n_draws + 1).select(
        F.col("id").alias("draw"),
        _draw(F.col("id"), "a", seed, n_ids).alias("_a"),
        _draw(F.col("id"), "b", seed, n_ids).alias("_b"),
    )
    ends1 = numbered.select(F.col("_k").alias("_a"), F.col("id").alias("_x"))
    ends2 = numbered.select(F.col("_k").alias("_b"), F.col("id").alias("_y"))
    # Each side has one row per draw, whatever the number of ids.
    small = F.broadcast if n_draws <= SMALL_ROWS else lambda rows: rows
    drawn = ends2.join(small(ends1.join(small(draws), "_a")), "_b")
    return (
        drawn.filter(F.col("_x") != F.col("_y"))
        .groupBy(F.least("_x", "_y").alias("id1"), F.greatest("_x", "_y").alias("id2"))
        .agg(F.min("draw").alias("draw"))
    )


def sample_random(
    ids: DataFrame, n: int = 10, seed: int = 42, used: DataFrame | None = None, id_col: str = "id"
) -> DataFrame:
    """The first ``n`` distinct unused pairs of a random sequence; fewer only if there are fewer.

    50 n draws come first and are doubled while pairs are missing and not every pair was drawn.
    """
    numbered = dense_index(ids.select(F.col(id_col).alias("id")).distinct(), ["id"], "_k")
    n_ids = numbered.count()
    if n_ids < 2 or n < 1:
        return numbered.select(F.col("id").alias("id1"), F.col("id").alias("id2")).limit(0)
    numbered = durable(numbered)
    n_draws = DRAWS_PER_PAIR * n
    while True:
        pairs = durable(_drawn_pairs(numbered, n_ids, n_draws, seed))
        unused = exclude_used(pairs, used)
        if unused.count() >= n or pairs.count() == n_ids * (n_ids - 1) // 2:
            return unused.orderBy("draw").limit(n).select("id1", "id2")
        n_draws *= 2


def _one_per_anchor(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """One random partner per anchor ``_anchor``, anchors in random order, ``n`` distinct pairs."""
    partner = F.struct(hash_order(seed, F.col("_anchor"), F.col("_other")), F.col("_other"))
    picked = pairs.groupBy("_anchor").agg(F.min(partner).alias("_p"))
    ends = picked.select("_anchor", F.col("_p")["_other"].alias("_other"))
    ordered = ends.groupBy(
        F.least("_anchor", "_other").alias("id1"), F.greatest("_anchor", "_other").alias("id2")
    ).agg(F.min(hash_order(seed, F.col("_anchor"))).alias("_o"))
    return ordered.orderBy("_o", "id1", "id2").limit(n).select("id1", "id2")


def both_directions(pairs: DataFrame) -> DataFrame:
    """``_anchor, _other`` both ways; the pairs are read once."""
    ends = [F.struct(F.col(a).alias("_anchor"), F.col(b).alias("_other")) for a, b in (("id1", "id2"), ("id2", "id1"))]
    return pairs.select(F.inline(F.array(*ends)))


def sample_distance_mid(
    sims: DataFrame,
    n: int = 10,
    target: float = 0.5,
    tol: float = 0.05,
    seed: int = 42,
    used: DataFrame | None = None,
) -> DataFrame:
    """Pairs with cosine in [target - tol, target + tol], one partner per anchor."""
    band = sims.filter(F.col("cosine").between(target - tol, target + tol)).select("id1", "id2")
    return _one_per_anchor(both_directions(exclude_used(band, used)), n, seed)


def sample_cooccurring(
    cooc: DataFrame,
    vectors: DataFrame,
    n: int = 10,
    min_shared: int = 1,
    max_sim: float = 0.9,
    seed: int = 42,
    used: DataFrame | None = None,
) -> DataFrame:
    """Uniform sample of pairs sharing enough documents whose cosine is not above ``max_sim``.

    Pairs without both vectors have no cosine and are dropped before anything else is joined.
    """
    enough = cooc.filter(F.col("shared") >= min_shared)
    for end in ("id1", "id2"):
        enough = enough.join(vectors.select(F.col("id").alias(end)), end, "left_semi")
    scored = pair_cosine(exclude_used(enough, used), vectors).filter(F.col("cosine") <= max_sim)
    order = hash_order(seed, F.col("id1"), F.col("id2"))
    return scored.select("id1", "id2", "shared", "cosine").orderBy(order, "id1", "id2").limit(n)


def sample_hard_negatives(
    vectors: DataFrame,
    incidence: DataFrame,
    n: int = 10,
    min_sim: float = 0.7,
    max_shared: int = 0,
    seed: int = 42,
    used: DataFrame | None = None,
    id_col: str = "kid",
    doc_col: str = "doc_id",
) -> DataFrame:
    """Similar pairs that share few documents (none counts as 0), one partner per anchor.

    Shared documents are counted for the similar pairs only.
    """
    near = similar_pairs(vectors, min_sim - 1e-9).filter(F.col("cosine") >= min_sim)
    fresh = durable(exclude_used(near.select("id1", "id2"), used))
    rare = shared_documents(fresh, incidence, id_col, doc_col).filter(F.col("shared") <= max_shared)
    return _one_per_anchor(
        rare.select(F.col("id1").alias("_anchor"), F.col("id2").alias("_other")), n, seed
    )


def sampling_sheet(pairs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrase text of both sides, six flags set to false, empty value."""
    names = phrases.select("kid", "phrase")
    one = names.select(F.col("kid").alias("id1"), F.col("phrase").alias("keyword 1"))
    two = names.select(F.col("kid").alias("id2"), F.col("phrase").alias("keyword 2"))
    joined = pairs.select("id1", "id2").join(one, "id1").join(two, "id2")
    flags = {s: [F.lit(False).alias(f"{f} {s}") for f in FLAGS] for s in (1, 2)}
    return joined.select(
        "keyword 1", *flags[1], "keyword 2", *flags[2], F.lit(None).cast("double").alias("value")
    )


def flag_edits(sheet: DataFrame, order_col: str) -> DataFrame:
    """``phrase, omit, method, thematic``: the last non-null edit of each flag per phrase."""
    sides = [
        sheet.select(
            F.col(f"keyword {s}").alias("phrase"),
            F.struct(F.col(order_col), F.lit(s)).alias("_at"),
            *[F.col(f"{f} {s}").cast("boolean").alias(f) for f in FLAGS],
        )
        for s in (1, 2)
    ]
    rows = sides[0].unionByName(sides[1])
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_at"))).alias(f) for f in FLAGS]
    return rows.filter(F.col("phrase").isNotNull()).groupBy("phrase").agg(*last)


def apply_flags(phrases: DataFrame, sheet: DataFrame, order_col: str) -> DataFrame:
    """Phrase table after the edits; null changes nothing, ambiguous phrases are left alone."""
    edits = flag_edits(sheet, order_col)
    edits = edits.select("phrase", *[F.col(f).alias(f"_{f}") for f in FLAGS])
    unique = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows = 1")
    usable = edits.join(unique.select("phrase"), "phrase", "left_semi")
    joined = phrases.join(usable, "phrase", "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in FLAGS else F.col(c) for c in phrases.columns]
    )


def active_phrases(phrases: DataFrame) -> DataFrame:
    return phrases.filter(~F.coalesce("omit", F.lit(False)))


def phrase_contexts(phrases: DataFrame, postings: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kid, doc_id, marked``: existing documents of each phrase, hyphens as blanks, phrase marked."""
    counts = postings.groupBy("kid").agg(F.count(F.lit(1)).alias("_n"))
    named = lookup(
        postings.select("kid", "doc_id"), phrases.select("kid", "phrase").join(counts, "kid"), ["kid"], "_n"
    )
    uses = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    texts = docs.select("doc_id", spaces_for_hyphens(F.col(text_col)).alias("_t")).join(uses, "doc_id")
    return lookup(named, texts, ["doc_id"], "_n").select(
        "kid", "doc_id", highlight(F.col("_t"), F.col("phrase")).alias("marked")
    )
