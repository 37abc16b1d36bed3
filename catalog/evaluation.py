"""Split-diagnostic and metric queries over labelled pairs made of all line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.operators import evaluation as J

from .base import query, table

SQL_PAIRS = """
pr as (select 'P' || l_partkey as kw1, 'S ' || l_suppkey || repeat(' of ' || l_returnflag, l_linenumber) as kw2,
              l_discount * 10 as value, 1 + l_orderkey % 5 as fold, (l_extendedprice - 900 * l_quantity) / 60000 as pred from lineitem),
cv as (select * from pr where fold between 1 and 4)
"""
#: Token counts of both sides of a pair.
SQL_LEN = r"""
ln as (select fold, len(regexp_extract_all(lower(kw1), '[\p{L}\p{N}]+')) as a, len(regexp_extract_all(lower(kw2), '[\p{L}\p{N}]+')) as b from cv)
"""


def pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    tail = F.repeat(F.concat(F.lit(" of "), F.col("l_returnflag")), F.col("l_linenumber"))
    return J.clean_pairs(
        li.select(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("kw1"),
            F.concat(F.lit("S "), F.col("l_suppkey").cast("string"), tail).alias("kw2"),
            (F.col("l_discount") * 10).alias("value"),
            (1 + F.col("l_orderkey") % 5).alias("fold"),
            ((F.col("l_extendedprice") - 900 * F.col("l_quantity")) / 60000).alias("pred"),
        )
    )


def cv(spark, sf):
    return J.cv_rows(pairs(spark, sf))


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "j01_clean_pairs",
    """select 'P' || l_partkey as kw1, 'S' || l_suppkey as kw2, round(l_discount * 15, 6) as value, (1 + l_orderkey % 5)::int as fold
       from lineitem where l_discount * 15 between 0 and 1 and l_returnflag <> 'A'""",
)
def clean_pairs(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("kw1"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("kw2"),
        (F.col("l_discount") * 15).alias("value"),
        (1 + F.col("l_orderkey") % 5).cast("string").alias("fold"),
    )
    return rounded(J.clean_pairs(raw), "value")


@query(
    "j02_cv_holdout",
    f"with {SQL_PAIRS} select case when fold = 5 then 'holdout' else 'cv' end as part, count(*) as n from pr group by 1",
)
def cv_holdout(spark, sf):
    p = pairs(spark, sf)
    both = J.cv_rows(p).withColumn("part", F.lit("cv")).unionByName(J.holdout_rows(p).withColumn("part", F.lit("holdout")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j03_fold_moments",
    f"""with {SQL_PAIRS} select fold::int as fold, count(*) as n, round(avg(value), 6) as label_mean,
             round(stddev_samp(value), 6) as label_std from cv group by 1""",
)
def fold_moments(spark, sf):
    return rounded(J.fold_moments(cv(spark, sf)), "label_mean", "label_std")


@query(
    "j04_label_histogram",
    f"""with {SQL_PAIRS}, b as (select fold, case when value > 0 and value <= 0.2 then 1 when value > 0.2 and value <= 0.4 then 2
             when value > 0.4 and value <= 0.6 then 3 when value > 0.6 and value <= 0.8 then 4 when value > 0.8 and value <= 1 then 5 end as bin from cv)
        select fold::int as fold, {', '.join(f'round(count(*) filter (bin = {i}) / count(*), 6) as bin_{i}' for i in range(1, 6))}
        from b where bin is not null group by 1""",
)
def label_histogram(spark, sf):
    return rounded(J.label_histogram(cv(spark, sf)), *[f"bin_{i}" for i in range(1, 6)])


@query(
    "j05_cross_fold_leaks",
    f"""with {SQL_PAIRS}, c as (select least(kw1, kw2) || '||' || greatest(kw1, kw2) as pair, fold, count(*) as n from cv group by 1, 2)
        select pair, fold::int as fold, n from c where pair in (select pair from c group by 1 having count(*) > 1)""",
)
def cross_fold_leaks(spark, sf):
    return J.cross_fold_leaks(cv(spark, sf))


@query(
    "j06_token_length_stats",
    f"""with {SQL_PAIRS},{SQL_LEN}, s as (select fold, 'kw1' as side, a as x from ln union all select fold, 'kw2', b from ln
             union all select fold, 'pair', a + b from ln)
        select fold::int as fold, side, count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd, min(x)::int as min,
               quantile_cont(x, 0.25)::double as q1, quantile_cont(x, 0.5)::double as median, quantile_cont(x, 0.75)::double as q3,
               max(x)::int as max from s group by 1, 2""",
)
def token_length_stats(spark, sf):
    return rounded(J.token_length_stats(cv(spark, sf)), "mean", "sd")


@query(
    "j07_long_pair_share",
    f"with {SQL_PAIRS},{SQL_LEN} select fold::int as fold, round(avg((a + b > 12)::int), 6) as long_share from ln group by 1",
)
def long_pair_share(spark, sf):
    return rounded(J.long_pair_share(cv(spark, sf)), "long_share")


@query(
    "j08_rare_token_score",
    rf"""with {SQL_PAIRS}, t as (select fold, unnest(regexp_extract_all(lower(kw1 || ' ' || kw2), '[\p{{L}}\p{{N}}]+')) as token from cv),
             f as (select fold, token, count(*) as own from t group by 1, 2),
             a as (select *, sum(own) over (partition by token) as total from f)
        select fold::int as fold, round(sum(own / greatest(1, total - own)::double) / sum(own), 6) as rare_score from a group by 1""",
)
def rare_token_score(spark, sf):
    return rounded(J.rare_token_score(cv(spark, sf)), "rare_score")


@query(
    "j09_cv_sizes",
    f"""with {SQL_PAIRS} select f::int as val_fold, count(*) filter (fold <> f) as n_train, count(*) filter (fold = f) as n_val
        from cv, (values (1), (2), (3), (4)) v(f) group by 1""",
)
def cv_sizes(spark, sf):
    return J.cv_sizes(pairs(spark, sf))


#: Vectors of parts and suppliers: the embedding with the same number.
SQL_SCORED = """
lv as (select vec_id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings),
nr as (select vec_id, sqrt(sum(x * x)) as len from lv group by 1),
un as materialized (select vec_id, list(x / len order by j) as u from lv join nr using (vec_id) group by 1),
ho as (select l_partkey as p, l_suppkey as s, l_discount * 10 as value from lineitem where 1 + l_orderkey % 5 = 5),
sc as (select 'P' || p as kw1, 'S' || s as kw2, value, list_dot_product(a.u, b.u) as pred
       from ho join un a on a.vec_id = p join un b on b.vec_id = s)
"""


def scored_holdout(spark, sf):
    emb = table(spark, sf, "embeddings")
    vecs = [
        emb.select(F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("phrase"), F.col("embedding").alias("vec"))
        for p in ("P", "S")
    ]
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("kw1"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("kw2"),
        (F.col("l_discount") * 10).alias("value"),
        (1 + F.col("l_orderkey") % 5).alias("fold"),
    )
    return J.score_pairs(J.holdout_rows(J.clean_pairs(li)), vecs[0].unionByName(vecs[1]))


@query(
    "j10_score_pairs",
    f"with {SQL_SCORED} select kw1, kw2, round(value, 6) as value, round(pred, 6) as pred, round(pred - value, 6) as error from sc",
)
def score_pairs(spark, sf):
    return rounded(scored_holdout(spark, sf), "value", "pred", "error")


_SQL_METRICS = """
rk as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rv,
              rank() over (order by pred) + (count(*) over (partition by pred) - 1) / 2.0 as rp from x)
"""


@query(
    "j11_metrics",
    f"""with {SQL_PAIRS}, x as (select value, pred from pr),{_SQL_METRICS}
        select count(*) as n, round(corr(rp, rv), 6) as spearman, round(corr(pred, value), 6) as pearson,
               round(avg(abs(pred - value)), 6) as mae, round(sqrt(avg((pred - value) ** 2)), 6) as rmse, round(avg(pred - value), 6) as bias from rk""",
)
def metrics(spark, sf):
    return rounded(J.metrics(pairs(spark, sf)), "spearman", "pearson", "mae", "rmse", "bias")


_SQL_FOLD_RHO = f"""
with {SQL_PAIRS}, rk as (select fold, rank() over (partition by fold order by value) + (count(*) over (partition by fold, value) - 1) / 2.0 as rv,
                            rank() over (partition by fold order by pred) + (count(*) over (partition by fold, pred) - 1) / 2.0 as rp from cv),
     fr as (select fold, corr(rp, rv) as spearman from rk group by 1)
"""


@query("j12_fold_spearman", f"{_SQL_FOLD_RHO} select fold::int as fold, round(spearman, 6) as spearman from fr")
def fold_spearman(spark, sf):
    return rounded(J.fold_spearman(cv(spark, sf)), "spearman")


@query("j12_cv_score", f"{_SQL_FOLD_RHO} select round(avg(spearman), 6) as cv_mean, round(stddev_pop(spearman), 6) as cv_std from fr")
def cv_score(spark, sf):
    return rounded(J.cv_score(J.fold_spearman(cv(spark, sf))), "cv_mean", "cv_std")


@query(
    "j13_fold_difficulty",
    """with r as (select l_linenumber as run, 1 + l_orderkey % 5 as fold, corr(l_quantity, l_discount) as spearman from lineitem group by 1, 2)
       select fold, round(avg(spearman), 6) as mean, round(stddev_pop(spearman), 6) as std from r group by 1""",
)
def fold_difficulty(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("run"), (1 + F.col("l_orderkey") % 5).alias("fold")
    ).agg(F.corr("l_quantity", "l_discount").alias("spearman"))
    return rounded(J.fold_difficulty(runs), "mean", "std")


@query(
    "j14_calibration",
    f"""with {SQL_PAIRS}, q as (select list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as e from pr),
             b as (select value, pred, greatest(1, len(list_filter(e, lambda t: t < value))) as bin, e from pr, q)
        select bin::int as bin, round(any_value(e[bin]), 6) as lo, round(any_value(e[bin + 1]), 6) as hi, count(*) as n,
               round(avg(value), 6) as true_mean, round(avg(pred), 6) as pred_mean, round(avg(abs(pred - value)), 6) as mae from b group by bin""",
)
def calibration(spark, sf):
    return rounded(J.calibration(pairs(spark, sf)), "lo", "hi", "true_mean", "pred_mean", "mae")


@query("j15_metrics_record")
def metrics_record(spark, sf):
    return J.metrics_record(J.metrics(pairs(spark, sf)), seed=42, holdout_fold=J.HOLDOUT_FOLD)
