"""Pair-sampling and label-loop queries.

Parts stand in for phrases, orders for documents, and embeddings (``vec_id`` = part) for
phrase vectors. Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.operators import sampling as H
from phrasegraph.operators import similarity as S

from .base import query, table
from .graphs import SQL_NOUN_TABLE, cooccurrence_parts, noun_table, part_incidence
from .phrases import docs_of
from .sources import SQL_LABELLED, labelled
from .vectors import SQL_SIM, vectors

#: Names of parts and suppliers with their ids, as a phrase table.
SQL_NAMES = """
names as (select 'P' || p_partkey as phrase, p_partkey::varchar as kid from part
          union all select 'S' || s_suppkey, 's' || s_suppkey from supplier)
"""
SQL_USED = """
used as (select distinct least(a.kid, b.kid) || '||' || greatest(a.kid, b.kid) as pair
         from lab join names a on a.phrase = kw1 join names b on b.phrase = kw2)
"""
SQL_INC = """
inc as (select distinct l_partkey as kid, l_orderkey as doc_id from lineitem),
cooc as materialized (select a.kid as id1, b.kid as id2, count(*) as shared
         from inc a join inc b on a.doc_id = b.doc_id and a.kid < b.kid group by 1, 2)
"""
#: Pairs already used: parts next to each other.
SQL_OLD = """
old as (select least(l_partkey::varchar, l_suppkey::varchar) || '||' || greatest(l_partkey::varchar, l_suppkey::varchar) as pair
        from lineitem)
"""


def names(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("phrase"), F.col("p_partkey").cast("string").alias("kid")
    )
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("phrase"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("kid"),
    )
    return p.unionByName(s)


def old_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(H.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("pair")).distinct()


@query(
    "h01_pair_key",
    "select distinct least(l_partkey::varchar, l_suppkey::varchar) || '||' || greatest(l_partkey::varchar, l_suppkey::varchar) as pair from lineitem",
)
def pair_key(spark, sf):
    return old_pairs(spark, sf)


@query(
    "h01_canonical_pairs",
    "select distinct least(l_partkey, l_suppkey) as id1, greatest(l_partkey, l_suppkey) as id2 from lineitem where l_partkey <> l_suppkey",
)
def canonical(spark, sf):
    return H.canonical_pairs(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("h02_used_pairs", f"with {SQL_LABELLED},{SQL_NAMES},{SQL_USED} select pair from used")
def used_pairs(spark, sf):
    return H.used_pairs(labelled(spark, sf), names(spark, sf))


@query(
    "h03_rater_pairs",
    f"with lab0 as (select * from ({SQL_LABELLED.strip().split('as ', 1)[1]}) where rater = 'R'), lab as (from lab0),{SQL_NAMES},{SQL_USED} select pair from used",
)
def rater_pairs(spark, sf):
    return H.rater_pairs(labelled(spark, sf), names(spark, sf), " r ")


@query(
    "h04_exclude_used",
    f"""with {SQL_INC},{SQL_OLD} select id1, id2, shared from cooc
        where least(id1::varchar, id2::varchar) || '||' || greatest(id1::varchar, id2::varchar) not in (from old)""",
)
def exclude_used(spark, sf):
    return H.exclude_used(cooccurrence_parts(spark, sf), old_pairs(spark, sf))


@query(
    "h05_sample_random",
    f"""with {SQL_OLD}, ids as (select p_partkey as id, row_number() over (order by p_partkey) as k from part),
             n as (select count(*) as n from part),
             d as (select i as draw, 1 + ('0x' || substr(md5('42|' || i || '|a'), 1, 15))::bigint % n as a,
                          1 + ('0x' || substr(md5('42|' || i || '|b'), 1, 15))::bigint % n as b
                   from (select unnest(generate_series(1, 1000)) as i), n),
             p as (select least(x.id, y.id) as id1, greatest(x.id, y.id) as id2, min(draw) as draw
                   from d join ids x on x.k = a join ids y on y.k = b where x.id <> y.id group by 1, 2)
        select id1, id2 from p where least(id1::varchar, id2::varchar) || '||' || greatest(id1::varchar, id2::varchar) not in (from old)
        order by draw limit 20""",
)
def sample_random(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return H.sample_random(ids, 20, 42, old_pairs(spark, sf))


_SQL_ANCHOR = """
pick as (select anchor, arg_min(other, (md5('42|' || anchor || '|' || other), other)) as other from cand group by 1),
ends as (select least(anchor, other) as id1, greatest(anchor, other) as id2, min(md5('42|' || anchor)) as o from pick group by 1, 2)
"""


@query(
    "h06_sample_distance_mid",
    f"""with {SQL_SIM},{SQL_OLD}, band as (select * from sim where cosine between 0.25 - 0.05 and 0.25 + 0.05
             and least(id1::varchar, id2::varchar) || '||' || greatest(id1::varchar, id2::varchar) not in (from old)),
             cand as (select id1 as anchor, id2 as other from band union all select id2, id1 from band),{_SQL_ANCHOR}
        select id1, id2 from ends order by o, id1, id2 limit 20""",
)
def sample_distance_mid(spark, sf):
    sims = S.similar_pairs(vectors(spark, sf), 0.25 - 0.05 - 1e-9)
    return H.sample_distance_mid(sims, 20, 0.25, 0.05, 42, old_pairs(spark, sf))


@query(
    "h07_sample_cooccurring",
    f"""with {SQL_SIM},{SQL_INC},{SQL_OLD}
        select id1, id2, shared, round(cosine, 6) as cosine from cooc join sim using (id1, id2)
        where shared >= 1 and cosine <= 0.9
          and least(id1::varchar, id2::varchar) || '||' || greatest(id1::varchar, id2::varchar) not in (from old)
        order by md5('42|' || id1 || '|' || id2), id1, id2 limit 50""",
)
def sample_cooccurring(spark, sf):
    out = H.sample_cooccurring(
        cooccurrence_parts(spark, sf), vectors(spark, sf), 50, 1, 0.9, 42, old_pairs(spark, sf)
    )
    return out.withColumn("cosine", F.round("cosine", 6))


@query(
    "h08_sample_hard_negatives",
    f"""with {SQL_SIM},{SQL_INC},{SQL_OLD},
             cand as (select id1 as anchor, id2 as other from sim left join cooc using (id1, id2)
                      where cosine >= 0.3 and coalesce(shared, 0) <= 0
                        and least(id1::varchar, id2::varchar) || '||' || greatest(id1::varchar, id2::varchar) not in (from old)),{_SQL_ANCHOR}
        select id1, id2 from ends order by o, id1, id2 limit 50""",
)
def sample_hard_negatives(spark, sf):
    return H.sample_hard_negatives(
        vectors(spark, sf), part_incidence(spark, sf), 50, 0.3, 0, 42, old_pairs(spark, sf)
    )


SQL_SHEET = """
pn as (select p_partkey as kid, 'P' || p_partkey as phrase from part)
"""


@query(
    "h09_sampling_sheet",
    f"""with {SQL_SHEET} select a.phrase as "keyword 1", false as "omit 1", false as "method 1", false as "thematic 1",
             b.phrase as "keyword 2", false as "omit 2", false as "method 2", false as "thematic 2", null::double as value
        from (select distinct least(l_partkey, l_suppkey) as id1, greatest(l_partkey, l_suppkey) as id2 from lineitem where l_partkey <> l_suppkey)
        join pn a on a.kid = id1 join pn b on b.kid = id2""",
)
def sampling_sheet(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("kid"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("phrase")
    )
    return H.sampling_sheet(canonical(spark, sf), parts)


FLAG_SQL = """with ph as (select p_partkey as kid, 'P' || p_partkey as phrase, false as omit, null::boolean as method, true as thematic from part),
            ed as (select 'P' || l_partkey as phrase, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey as rn, 1 as side,
                          case l_returnflag when 'R' then true when 'N' then false end as omit,
                          l_linestatus = 'F' as method, case when l_quantity > 40 then false end as thematic from lineitem
                   union all
                   select 'P' || l_suppkey, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey, 2, l_tax > 0.05, null, l_discount > 0.05 from lineitem),
            la as (select phrase, arg_max(omit, (rn, side)) filter (omit is not null) as omit,
                          arg_max(method, (rn, side)) filter (method is not null) as method,
                          arg_max(thematic, (rn, side)) filter (thematic is not null) as thematic from ed group by 1)
       select kid, ph.phrase, coalesce(la.omit, ph.omit) as omit, coalesce(la.method, ph.method) as method,
              coalesce(la.thematic, ph.thematic) as thematic from ph left join la on la.phrase = ph.phrase"""


@query("h10_apply_flags", FLAG_SQL)
def apply_flags(spark, sf):
    phrases = table(spark, sf, "part").select(
        F.col("p_partkey").alias("kid"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("phrase"),
        F.lit(False).alias("omit"),
        F.lit(None).cast("boolean").alias("method"),
        F.lit(True).alias("thematic"),
    )
    return H.apply_flags(phrases, edit_sheet(spark, sf), "row_no")


def edit_sheet(spark, sf, *more):
    """Every line item as a submitted row: part left, supplier number right."""
    flag, nothing = F.col("l_returnflag"), F.lit(None).cast("boolean")
    return table(spark, sf, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("row_no"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("keyword 1"),
        F.when(flag == "R", True).when(flag == "N", False).alias("omit 1"),
        (F.col("l_linestatus") == "F").alias("method 1"),
        F.when(F.col("l_quantity") > 40, False).alias("thematic 1"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("keyword 2"),
        (F.col("l_tax") > 0.05).alias("omit 2"),
        nothing.alias("method 2"),
        (F.col("l_discount") > 0.05).alias("thematic 2"),
        (F.col("l_discount") * 10).alias("value"),
        *more,
    )


@query(
    "h11_active_phrases",
    "select vec_id as kid from embeddings where not coalesce(label in (1, 3), false) order by vec_id",
)
def active_phrases(spark, sf):
    flags = table(spark, sf, "embeddings").select(F.col("vec_id").alias("kid"), F.col("label").isin(1, 3).alias("omit"))
    return H.active_phrases(flags).select("kid").orderBy("kid")


@query(
    "h12_phrase_contexts",
    f"""with {SQL_NOUN_TABLE}
        select kid, doc_id, md5(regexp_replace(replace(text, '-', ' '), '(?i)(' || phrase || ')', '<mark>\\1</mark>', 'g')) as marked
        from npost join nkw using (kid) join documents using (doc_id)""",
)
def phrase_contexts(spark, sf):
    phrases, postings = noun_table(spark, sf)
    out = H.phrase_contexts(phrases, postings, docs_of(spark, sf))
    return out.withColumn("marked", F.md5("marked"))
