"""Topic-model queries: orders are documents, parts phrases, embeddings phrase features.

Model parameters come from hashes of their row and column, so SQL can compute them as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.functions.dense import as_doubles
from phrasegraph.operators import topics as K
from phrasegraph.plans.durable import durable, scratch_path

from .base import query, table
from .graphs import part_incidence
from .vectors import SQL_UNIT, vectors

TOPICS, DIMS = 4, 64


def sql_u(*parts: str) -> str:
    """A number in [-0.5, 0.5) from the hash of the parts."""
    key = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0::double - 0.5)"


def hashed(*parts):
    digest = F.md5(F.concat_ws("|", *[p if not isinstance(p, str) else F.lit(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) - F.lit(0.5)


def parameters(spark, name: str, rows: int, cols: int):
    values = [hashed(name, F.col("id").cast("string"), F.lit(str(c + 1))).alias(f"c{c}") for c in range(cols)]
    return spark.range(1, rows + 1).select(F.col("id").alias("row"), F.array(*values).alias("vec"))


#: All parts of all orders that have features; presence and quantities.
SQL_TRIPLETS = """
li as (select l_orderkey as doc_id, l_partkey as kid, l_quantity as q from lineitem),
di as materialized (select o_orderkey as doc_id, row_number() over (order by o_orderkey) as ii from orders),
ki as materialized (select vec_id as kid, row_number() over (order by vec_id) as jj from (select distinct vec_id from embeddings)),
tr as (select ii, jj, 1 as vv from (select distinct kid, doc_id from li) join di using (doc_id) join ki using (kid)),
tq as materialized (select ii, jj, sum(round(q))::bigint as vv from li join di using (doc_id) join ki using (kid) group by 1, 2)
"""


def triplets(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    phrases = table(spark, sf, "embeddings").select(F.col("vec_id").alias("kid"))
    return K.presence_triplets(phrases, part_incidence(spark, sf), docs)


def quantities(spark, sf):
    """Triplets with line quantities as counts, duplicates not yet summed."""
    _, docs, kids = triplets(spark, sf)
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("kid"), F.col("l_quantity").alias("vv")
    )
    return li.join(docs, "doc_id").join(kids, "kid").select("ii", "jj", "vv"), docs, kids


@query("k01_presence_triplets", f"with {SQL_TRIPLETS} select ii, jj, vv from tr")
def presence(spark, sf):
    return triplets(spark, sf)[0]


@query("k02_coalesce_triplets", f"with {SQL_TRIPLETS} select ii, jj, vv from tq")
def coalesced(spark, sf):
    return K.coalesce_triplets(quantities(spark, sf)[0])


@query(
    "k03_triplet_summary",
    f"""with {SQL_TRIPLETS} select (select count(*) from di) as "D", (select count(*) from ki) as "K", count(*) as "NNZ",
             round(count(*) / ((select count(*) from di) * (select count(*) from ki))::double, 9) as density,
             0 as not_positive, 0 as out_of_bounds from tr""",
)
def summary(spark, sf):
    tr, docs, kids = triplets(spark, sf)
    out = K.triplet_summary(tr, docs.count(), kids.count())
    return out.withColumn("density", F.round("density", 9))


@query("k04_phrase_features")
def phrase_features(spark, sf):
    kids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).distinct()
    return K.phrase_features(vectors(spark, sf), kids, 16)


def doc_vectors(spark, sf):
    """Three plain covariates per order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.array(
            F.col("o_totalprice") / 100000.0, (F.col("o_custkey") % 10).cast("double"), (F.col("o_orderkey") % 7).cast("double")
        ).alias("vec"),
    )


@query("k04_doc_features")
def doc_features(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return K.doc_features(doc_vectors(spark, sf), docs, 2)


@query(
    "k05_row_pointers",
    f"""with {SQL_TRIPLETS}, c as (select di.ii, count(tr.jj) as n_cells from di left join tr using (ii) group by 1)
        select ii, n_cells, (1 + sum(n_cells) over (order by ii) - n_cells)::bigint as row_ptr from c""",
)
def row_pointers(spark, sf):
    tr, docs, _ = triplets(spark, sf)
    return K.row_pointers(tr, docs)


@query(
    "k06_multinomial_constants",
    f"""with {SQL_TRIPLETS} select ii, sum(vv)::bigint as n_doc, round(lgamma(sum(vv) + 1) - sum(lgamma(vv + 1)), 6) as log_const
        from tq group by 1""",
)
def constants(spark, sf):
    out = K.multinomial_constants(K.coalesce_triplets(quantities(spark, sf)[0]))
    return out.withColumn("log_const", F.round("log_const", 6))


_SQL_PHI = f"""{SQL_UNIT},
pb as (select m, l, {sql_u("'B'", "l::varchar", "m::varchar")} as w from (select unnest(generate_series(1, {DIMS})) as m) a, (select unnest(generate_series(1, {TOPICS})) as l) b),
lg as (select id, l, 2.0 * sum(u[m] * w) as a from un, pb group by 1, 2),
mx as (select l, max(a) as top from lg group by 1),
ls as (select l, max(top) + ln(sum(exp(a - top))) as z from lg join mx using (l) group by 1),
ph as materialized (select id, l, exp(a - z) as phi from lg join ls using (l))
"""


def features_of_phrases(spark, sf):
    from phrasegraph.operators.similarity import normalized

    return normalized(vectors(spark, sf))


def phi(spark, sf):
    # B is M x L; its rows are the feature dimensions.
    values = [hashed("B", F.lit(str(t + 1)), F.col("id").cast("string")).alias(f"c{t}") for t in range(TOPICS)]
    b = spark.range(1, DIMS + 1).select(F.col("id").alias("row"), F.array(*values).alias("vec"))
    return K.topic_phrases(features_of_phrases(spark, sf), b, 2.0)


@query("k07_topic_phrases", f"with {_SQL_PHI} select id, l as topic, round(phi, 9) as phi from ph")
def topic_phrases(spark, sf):
    return phi(spark, sf).select("id", F.posexplode("phi").alias("topic", "phi")).select(
        "id", (F.col("topic") + 1).cast("long").alias("topic"), F.round("phi", 9).alias("phi")
    )


_SQL_THETA = f"""
dx as (select o_orderkey as id, [o_totalprice / 100000.0, (o_custkey % 10)::double, (o_orderkey % 7)::double] as x from orders),
eta as (select id, l, x[1] * {sql_u("'W'", "'1'", "l::varchar")} + x[2] * {sql_u("'W'", "'2'", "l::varchar")} + x[3] * {sql_u("'W'", "'3'", "l::varchar")}
               + {sql_u("'b'", "'1'", "l::varchar")}
               + {sql_u("'Lambda'", "l::varchar", "'1'")} * {sql_u("'z'", "id::varchar", "'1'")} + {sql_u("'Lambda'", "l::varchar", "'2'")} * {sql_u("'z'", "id::varchar", "'2'")}
               + {sql_u("'sigma'", "'1'", "l::varchar")} * {sql_u("'eps'", "id::varchar", "l::varchar")} as e
        from dx, (select unnest(generate_series(1, {TOPICS})) as l) t),
th as materialized (select id, l, exp(e - max(e) over (partition by id)) / sum(exp(e - m)) over (partition by id) as theta
       from (select *, max(e) over (partition by id) as m from eta))
"""


def theta(spark, sf):
    x = doc_vectors(spark, sf)
    key = F.col("id").cast("string")
    latent = x.select(
        "id",
        F.array(*[hashed("z", key, F.lit(str(r + 1))) for r in range(2)]).alias("z"),
        F.array(*[hashed("eps", key, F.lit(str(t + 1))) for t in range(TOPICS)]).alias("eps"),
    )
    return K.doc_topics(
        x,
        latent,
        parameters(spark, "W", 3, TOPICS),
        parameters(spark, "b", 1, TOPICS),
        parameters(spark, "Lambda", TOPICS, 2),
        parameters(spark, "sigma", 1, TOPICS),
    )


@query("k08_doc_topics", f"with {_SQL_THETA} select id, l as topic, round(theta, 6) as theta from th")
def doc_topics(spark, sf):
    return theta(spark, sf).select("id", F.posexplode("theta").alias("topic", "theta")).select(
        "id", (F.col("topic") + 1).cast("long").alias("topic"), F.round("theta", 6).alias("theta")
    )


@query(
    "k09_doc_log_likelihood",
    f"""with {SQL_TRIPLETS},{_SQL_PHI},{_SQL_THETA},
             pr as (select ii, jj, vv, sum(phi * theta) as p from tq join di using (ii) join ki using (jj)
                    join ph on ph.id = kid join th on th.id = doc_id and th.l = ph.l group by 1, 2, 3),
             cs as (select ii, lgamma(sum(vv) + 1) - sum(lgamma(vv + 1)) as c from tq group by 1)
        select ii, round(sum(vv * ln(p)) + max(c), 6) as log_lik from pr join cs using (ii) group by 1""",
)
def log_likelihood(spark, sf):
    raw, docs, kids = quantities(spark, sf)
    per_kid = phi(spark, sf).join(kids, F.col("id") == F.col("kid")).select("jj", "phi")
    per_doc = theta(spark, sf).join(docs, F.col("id") == F.col("doc_id")).select("ii", "theta")
    out = K.doc_log_likelihood(K.coalesce_triplets(raw), per_kid, per_doc)
    return out.withColumn("log_lik", F.round("log_lik", 6))


@query("k10_bundle")
def bundle(spark, sf):
    tr, docs, kids = triplets(spark, sf)
    e = features_of_phrases(spark, sf)
    x = K.doc_features(doc_vectors(spark, sf), docs.select(F.col("doc_id").alias("id")))
    x = x.select("id", as_doubles(F.col("vec")).alias("vec"))
    return K.write_bundle(
        scratch_path(spark, "bundle"), durable(K.coalesce_triplets(tr)), e, x, docs, kids, L=TOPICS, R=2
    )


@query(
    "k10_bundle_rows",
    f"""with {SQL_TRIPLETS}
        select tq.ii, tq.jj, tq.vv, doc_id, kid, round(embedding[1]::double, 6) as e1, round(o_totalprice / 100000.0::double, 7) as x1
        from tq join di using (ii) join ki using (jj) join embeddings on vec_id = kid join orders on o_orderkey = doc_id""",
)
def bundle_rows(spark, sf):
    """Every cell of the written bundle with its features, found by row number alone."""
    raw, docs, kids = quantities(spark, sf)
    path = scratch_path(spark, "bundle")
    e = vectors(spark, sf).dropDuplicates(["id"])
    K.write_bundle(path, K.coalesce_triplets(raw), e, doc_vectors(spark, sf), docs, kids, L=TOPICS, R=2)
    cells, e, x, ids, keys = (spark.read.parquet(f"{path}/{t}") for t in ("triplets", "E", "X", "documents", "phrases"))
    e = e.select("jj", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("e1"))
    x = x.select("ii", F.round(F.get("vec", F.lit(0)), 7).alias("x1"))
    return cells.join(e.join(keys, "jj"), "jj").join(x.join(ids, "ii"), "ii")


@query("k04_phrase_lengths", "select distinct vec_id as id, 16 as dims, 1.0::double as length from embeddings")
def phrase_lengths(spark, sf):
    """Projected phrase features have unit length."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v * v))
    return phrase_features(spark, sf).select("id", F.size("vec").alias("dims"), F.round(length, 6).alias("length"))


@query(
    "k04_doc_moments",
    "select dim::bigint as dim, count(*) as n, 0.0::double as mean, 1.0::double as sd from orders, (values (0), (1)) t(dim) group by 1",
)
def doc_moments(spark, sf):
    """Projected document features have mean 0 and deviation 1 in every column."""
    cells = doc_features(spark, sf).select(F.posexplode(as_doubles(F.col("vec"))).alias("dim", "v"))
    return cells.groupBy(F.col("dim").cast("long").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.abs(F.round(F.avg("v"), 6)).alias("mean"),
        F.round(F.stddev_samp("v"), 6).alias("sd"),
    )
