"""Vector queries over ``embeddings`` (and ``documents`` for the term encoders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.functions.text import char_count, word_count
from phrasegraph.operators import projection as PR
from phrasegraph.operators import similarity as S
from phrasegraph.operators import tokens as TK
from phrasegraph.plans.durable import durable

from .base import query, table
from .phrases import SQL_TOKENS

#: Unit vectors in long form: id, j, x.
SQL_UNIT = """
lv as (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
nr as (select id, sqrt(sum(x * x)) as len from lv group by 1),
un as materialized (select id, list(x / case when len = 0 then 1 else len end order by j) as u
       from lv join nr using (id) group by id)
"""
SQL_SIM = SQL_UNIT + """,
sim as materialized (select a.id as id1, b.id as id2, list_dot_product(a.u, b.u) as cosine
        from un a join un b on a.id < b.id)
"""
SQL_KNN = SQL_SIM + """,
nnr as materialized (select id, nn, c, row_number() over (partition by id order by c desc, nn) as rank from
        (select id1 as id, id2 as nn, round(cosine, 9) as c from sim
         union all select id2, id1, round(cosine, 9) from sim))
"""
SQL_SPECTRUM = """
lv as (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
vr as (select j, var_samp(x) as v from lv group by 1),
sp as materialized (select row_number() over (order by v desc, j) as m, v / sum(v) over () as evr from vr),
cu as (select m, evr, sum(evr) over (order by m) as cum_evr from sp)
"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def spectrum(spark, sf):
    """Variance share per dimension, largest first: a spectrum SQL can compute as well."""
    from pyspark.sql import Window

    diag = PR.covariance(vectors(spark, sf)).filter("i = j").select("i", F.col("cov").alias("v"))
    total = diag.agg(F.sum("v").alias("t"))
    order = Window.orderBy(F.desc("v"), "i")  # one row per dimension
    return diag.join(F.broadcast(total)).select(
        F.row_number().over(order).alias("m"), (F.col("v") / F.col("t")).alias("evr")
    )


@query("d01_encode_tf", f"with {SQL_TOKENS} select doc_id, term, count(*)::double as w from tok group by 1, 2")
def encode_tf(spark, sf):
    return TK.term_counts(table(spark, sf, "documents"))


@query(
    "d01_encode_tfidf",
    f"""with {SQL_TOKENS}, tf as (select doc_id, term, count(*) as c from tok group by 1, 2),
             df as (select term, count(*) as d from tf group by 1), n as (select count(*) as n from documents)
        select doc_id, term, round(c * ln((n + 1.0)::double / (d + 1)), 6) as w from tf join df using (term), n""",
)
def encode_tfidf(spark, sf):
    docs = table(spark, sf, "documents")
    return TK.tfidf(TK.term_counts(docs), docs.count()).withColumn("w", F.round("w", 6))


@query("d01_encode_with_model")
def encode_with_model(spark, sf):
    """The model hook with a toy encoder: letter frequencies."""

    def make():
        letters = "abcdefghijklmnopqrstuvwxyz"
        return lambda texts: [[t.lower().count(ch) / max(1, len(t)) for ch in letters] for t in texts]

    return TK.encode_with(table(spark, sf, "documents"), make)


@query(
    "d02_l2_normalize",
    f"with {SQL_UNIT} select id, j, round(u[j], 6) as x from (select id, u, unnest(generate_series(1, len(u))) as j from un)",
)
def l2_normalize(spark, sf):
    units = S.normalized(vectors(spark, sf))
    return units.select("id", F.posexplode("vec").alias("j", "x")).select(
        "id", (F.col("j") + 1).cast("long").alias("j"), F.round("x", 6).alias("x")
    )


@query("d03_similar_vectors", f"with {SQL_SIM} select id1, id2, round(cosine, 6) as cosine from sim where cosine > 0.3")
def similar_vectors(spark, sf):
    return S.similar_pairs(vectors(spark, sf), 0.3).withColumn("cosine", F.round("cosine", 6))


@query(
    "d03_similarity_components",
    f"""with recursive {SQL_SIM}, lk as (select id1 as s, id2 as d from sim where cosine > 0.4
             union all select id2, id1 from sim where cosine > 0.4),
        reach(id, other) as (select s, s from lk union select r.id, l.d from reach r join lk l on l.s = r.other)
        select id, min(other) as component from reach group by id""",
)
def similarity_components(spark, sf):
    return S.similarity_components(vectors(spark, sf), 0.4)


@query(
    "d04_pairwise_cosine",
    f"""with {SQL_SIM} select id1, id2, round(cosine, 6) as cosine from sim
        union all select id, id, round(list_dot_product(u, u), 6) from un""",
)
def pairwise_cosine(spark, sf):
    return S.pairwise_cosine(vectors(spark, sf), allow_large=True).withColumn("cosine", F.round("cosine", 6))


@query(
    "d05_pair_cosine",
    f"""with {SQL_UNIT}, p as (select distinct l_partkey as id1, l_suppkey as id2 from lineitem)
        select id1, id2, round(list_dot_product(a.u, b.u), 6) as cosine
        from p join un a on a.id = id1 join un b on b.id = id2""",
)
def pair_cosine(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"))
    return S.pair_cosine(pairs.distinct(), vectors(spark, sf)).withColumn("cosine", F.round("cosine", 6))


@query(
    "d06_active_similarity",
    f"""with {SQL_SIM}, act as (select vec_id as id from embeddings where not coalesce(label = 0, false))
        select id1, id2, round(cosine, 6) as cosine from sim
        where cosine > 0.3 and id1 in (from act) and id2 in (from act)""",
)
def active_similarity(spark, sf):
    flags = table(spark, sf, "embeddings").select(F.col("vec_id").alias("kid"), (F.col("label") == 0).alias("omit"))
    return S.active_pairs(vectors(spark, sf), flags, 0.3).withColumn("cosine", F.round("cosine", 6))


@query("d07_nearest", f"with {SQL_KNN} select id, nn, rank, round(c, 6) as cosine from nnr where rank <= 10")
def nearest(spark, sf):
    return S.nearest(vectors(spark, sf), 10).select(
        "id", "nn", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine")
    )


@query(
    "d07_nearest_skip_first",
    f"with {SQL_KNN} select id, nn, rank - 1 as rank from nnr where rank between 2 and 11",
)
def nearest_skip_first(spark, sf):
    return S.nearest(vectors(spark, sf), 10, skip_first=True).select("id", "nn", F.col("rank").cast("long").alias("rank"))


@query(
    "d08_hub_counts",
    f"""with {SQL_KNN} select e.vec_id as id, count(n.nn) as hits from embeddings e
        left join nnr n on n.nn = e.vec_id and n.rank = 1 group by 1""",
)
def hub_counts(spark, sf):
    v = vectors(spark, sf)
    return S.hub_counts(S.nearest(v, 1), v)


@query(
    "d09_hub_summary",
    f"""with {SQL_KNN}, h as (select e.vec_id as id, count(n.nn) as hits from embeddings e
             left join nnr n on n.nn = e.vec_id and n.rank = 1 group by 1)
        select round(avg(hits), 6) as hub_mean, round(quantile_cont(hits, 0.95), 6) as hub_p95, max(hits) as hub_max from h""",
)
def hub_summary(spark, sf):
    v = vectors(spark, sf)
    out = S.hub_summary(S.hub_counts(S.nearest(v, 1), v))
    return out.withColumn("hub_mean", F.round("hub_mean", 6)).withColumn("hub_p95", F.round("hub_p95", 6))


@query(
    "d10_neighbor_overlap",
    f"""with {SQL_KNN}, a as (select id, nn from nnr where rank <= 10), b as (select id, nn from nnr where rank between 2 and 11),
             c as (select a.id, count(*) as n from a join b using (id, nn) group by 1)
        select id, round(coalesce(c.n, 0) / (20.0 - coalesce(c.n, 0)), 6) as jaccard
        from (select distinct id from a) left join c using (id)""",
)
def neighbor_overlap(spark, sf):
    v = vectors(spark, sf)
    a, b = S.nearest(v, 10), S.nearest(v, 10, skip_first=True)
    return S.neighbor_overlap(a, b).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "d11_covariance",
    """with lv as materialized (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings)
       select a.j::int as i, b.j::int as j, round(covar_samp(a.x, b.x), 6) as cov
       from lv a join lv b on a.id = b.id and a.j <= b.j group by 1, 2""",
)
def covariance(spark, sf):
    return PR.covariance(vectors(spark, sf)).withColumn("cov", F.round(F.col("cov") + 0.0, 6))


@query("d12_pca_components")
def pca_components(spark, sf):
    v = vectors(spark, sf)
    return PR.fit_pca(v, 10).components(v)


@query("d12_pca_spectrum")
def pca_spectrum(spark, sf):
    v = vectors(spark, sf)
    return PR.cumulative(PR.fit_pca(v).spectrum(v))


@query("d12_pca_scores")
def pca_scores(spark, sf):
    return PR.reduce_dims(vectors(spark, sf), 16)


@query(
    "d12_pca_score_lengths",
    """with lv as (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
            mn as (select j, avg(x) as m from lv group by 1)
       select id, round(sum((x - m) * (x - m)), 6) as length_sq from lv join mn using (j) group by 1""",
)
def pca_score_lengths(spark, sf):
    """All components together keep each row's distance to the mean."""
    v = vectors(spark, sf)
    scores = PR.pc_scores(v, PR.fit_pca(v))
    length = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return scores.select("id", F.round(length, 6).alias("length_sq"))


@query(
    "d12_pca_orthonormal",
    """select a::int as a, b::int as b, case when a = b then 1.0 else 0.0 end::double as product
       from generate_series(1, 10) x(a), generate_series(1, 10) y(b) where a <= b""",
)
def pca_orthonormal(spark, sf):
    """Products of the loadings of any two components: 1 with itself, else 0."""
    cells = pca_components(spark, sf)
    left = cells.select(F.col("component").alias("a"), "dim", F.col("loading").alias("_x"))
    right = cells.select(F.col("component").alias("b"), "dim", F.col("loading").alias("_y"))
    product = F.round(F.sum(F.col("_x") * F.col("_y")), 6) + F.lit(0.0)
    return left.join(right, "dim").filter("a <= b").groupBy("a", "b").agg(product.alias("product"))


@query(
    "d12_pca_variance",
    "select max(len(embedding))::bigint as components, 1.0::double as total, 0::bigint as rising from embeddings",
)
def pca_variance(spark, sf):
    """Shares of variance add up to 1 and never rise."""
    v = vectors(spark, sf)
    shares = PR.fit_pca(v).spectrum(v)
    after = shares.select((F.col("m") - 1).alias("m"), F.col("evr").alias("_next"))
    return shares.join(after, "m", "left").agg(
        F.count(F.lit(1)).alias("components"),
        F.round(F.sum("evr"), 9).alias("total"),
        F.count_if(F.col("_next") > F.col("evr") + 1e-12).alias("rising"),
    )


@query(
    "d13_evr_targets",
    f"""with {SQL_SPECTRUM} select t as target, min(case when cum_evr >= t - 1e-12 then m end) as m
        from cu, (values (0.90::double), (0.95::double), (0.99::double)) v(t) group by 1""",
)
def evr_targets(spark, sf):
    return PR.evr_targets(spectrum(spark, sf)).withColumn("m", F.col("m").cast("long"))


@query(
    "d14_signal_count",
    f"""with {SQL_SPECTRUM}, k as (select count(*) as d, median(evr) as mid from sp), n as (select count(*) as n from embeddings)
        select count(*) as n_signal from sp, k, n where evr > mid * power(1 + sqrt(d / (n - 1.0)), 2)""",
)
def signal_count(spark, sf):
    return PR.signal_count(spectrum(spark, sf), table(spark, sf, "embeddings").count())


@query(
    "d15_knee_index",
    f"""with {SQL_SPECTRUM}, e as (select min_by(cum_evr, m) as y1, max_by(cum_evr, m) as y2, max(m) as x2 from cu),
             d as (select m, round(abs((y2 - y1) * m - (x2 - 1) * cum_evr + x2 * y1 - y2) / sqrt((y2 - y1) * (y2 - y1) + (x2 - 1) * (x2 - 1)), 12) as dist from cu, e)
        select m::int as m_knee from d order by dist desc, m limit 1""",
)
def knee_index(spark, sf):
    return PR.knee_index(spectrum(spark, sf))


@query(
    "d16_centroid_similarity",
    """with lv as materialized (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
            mu as (select j, avg(x) as mx from lv group by 1), nm as (select sqrt(sum(mx * mx)) as len from mu)
       select id, round(sum(x * mx / len), 6) as centroid_sim from lv join mu using (j), nm group by 1""",
)
def centroid_similarity(spark, sf):
    return PR.centroid_similarity(vectors(spark, sf)).withColumn("centroid_sim", F.round("centroid_sim", 6))


@query("d16_genericity")
def genericity(spark, sf):
    v = vectors(spark, sf)
    return PR.genericity(v, PR.fit_pca(v, 1))


@query(
    "d17_spearman",
    r"""with t as (select length(text) as a, len(regexp_extract_all(text, '\S+')) as b from documents),
             r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra,
                          rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from t)
        select count(*) as n, round(corr(ra, rb), 6) as spearman from r""",
)
def spearman(spark, sf):
    lengths = table(spark, sf, "documents").select(
        char_count(F.col("text")).alias("a"), word_count(F.col("text")).alias("b")
    )
    return PR.spearman(lengths, "a", "b").withColumn("spearman", F.round("spearman", 6))


def texts_of_vectors(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("d17_pc1_correlations")
def pc1_correlations(spark, sf):
    v = vectors(spark, sf)
    return PR.pc1_correlations(v, PR.fit_pca(v, 1), texts_of_vectors(spark, sf))


@query(
    "d17_axis_correlations",
    r"""with lv as materialized (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
            mu as (select j, avg(x) as mx from lv group by 1), nm as (select sqrt(sum(mx * mx)) as len from mu),
            cs as (select id, round(sum(x * mx / len), 9) as centroid_sim from lv join mu using (j), nm group by 1),
            t as materialized (select id, round(embedding[1]::double, 9) as a, centroid_sim, length(text) as n_chars, len(regexp_extract_all(text, '\S+')) as n_tokens
                  from cs join embeddings on vec_id = id left join documents on doc_id = id),
            l as (select 'centroid_sim' as name, a, centroid_sim::double as b from t union all
                  select 'n_tokens', a, n_tokens from t union all select 'n_chars', a, n_chars from t),
            r as (select name, rank() over (partition by name order by a) + (count(*) over (partition by name, a) - 1) / 2.0 as ra,
                         rank() over (partition by name order by b) + (count(*) over (partition by name, b) - 1) / 2.0 as rb
                  from l where b is not null)
        select name, count(*) as n, round(corr(ra, rb), 6) as spearman from r group by name""".replace("\\\\", "\\"),
)
def axis_correlations(spark, sf):
    """The three correlations for a given axis, the first coordinate."""
    v = vectors(spark, sf)
    lengths = texts_of_vectors(spark, sf).select("id", char_count(F.col("text")).alias("n_chars"), word_count(F.col("text")).alias("n_tokens"))
    first = v.select("id", F.round(F.col("vec")[0].cast("double"), 9).alias("pc1"))
    near = PR.centroid_similarity(v).withColumn("centroid_sim", F.round("centroid_sim", 9))
    scores = durable(first.join(near, "id").join(lengths, "id", "left"))
    out = PR.axis_correlations(scores, ["centroid_sim", "n_tokens", "n_chars"])
    return out.withColumn("spearman", F.round("spearman", 6))


@query("d18_removal_sweep")
def removal_sweep(spark, sf):
    return PR.removal_sweep(vectors(spark, sf))


@query("d19_keep_sweep")
def keep_sweep(spark, sf):
    return PR.keep_sweep(vectors(spark, sf))[0]


@query("d20_choose_m")
def choose_m(spark, sf):
    v = vectors(spark, sf)
    overlaps, fit = PR.keep_sweep(v)
    spec = fit.spectrum(v)
    return PR.choose_m(overlaps, PR.signal_count(spec, fit.n_rows), PR.knee_index(spec))


@query(
    "d21_sample_rows",
    "select vec_id as id from embeddings order by md5('42|' || vec_id::varchar), vec_id limit 200",
)
def sample_rows(spark, sf):
    return S.sample_rows(vectors(spark, sf), 200).select("id")


@query(
    "d22_standardize_columns",
    """with lv as materialized (select vec_id as id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
            st as (select j, avg(x) as mx, stddev_samp(x) as sx from lv group by 1)
       select id, j, round((x - mx) / case when sx = 0 then 1 else sx end, 6) as x from lv join st using (j)""",
)
def standardize_columns(spark, sf):
    out = PR.standardize(vectors(spark, sf))
    return out.select("id", F.posexplode("vec").alias("j", "x")).select(
        "id", (F.col("j") + 1).cast("long").alias("j"), F.round(F.col("x"), 6).alias("x")
    )


@query(
    "d23_missing_vectors",
    "select p_partkey as id from part where p_partkey not in (select vec_id from embeddings)",
)
def missing_vectors(spark, sf):
    return S.missing_vectors(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), vectors(spark, sf))


@query(
    "d23_align",
    "select id, round(list_sum(embedding::double[]), 4) as total from (select distinct vec_id as id from embeddings where label is not null) join embeddings on id = vec_id",
)
def align(spark, sf):
    ids = table(spark, sf, "embeddings").filter("label is not null").select(F.col("vec_id").alias("id")).distinct()
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return S.align(ids, vectors(spark, sf)).select("id", F.round(total, 4).alias("total"))
