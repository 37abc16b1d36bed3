"""Round trips of the pipeline's tables through files in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.operators import similarity as S
from phrasegraph.plans.durable import scratch_path as scratch
from phrasegraph.sources import tables as IO
from phrasegraph.sources import versions

from .base import query, table
from .graphs import SQL_NOUN_TABLE, noun_table
from .vectors import SQL_SIM, vectors


@query("a01_documents_csv", "select doc_id::varchar as doc_id, text, lang from documents where text is not null")
def documents_csv(spark, sf):
    path = scratch(spark, "documents")
    IO.write_documents(table(spark, sf, "documents"), path)
    return IO.read_documents(spark, path, "doc_id", "text").select("doc_id", "text", "lang")


@query(
    "a01_non_empty",
    "select conv_id::varchar as conv_id, turn from conversations where text is not null and length(text) > 0",
)
def non_empty(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("conv_id", F.col("conv_id").cast("string"))
    return IO.non_empty(rows, "conv_id", "text").select("conv_id", "turn")


@query("a02_read_phrases", f"with {SQL_NOUN_TABLE} select kid, doc_id::varchar as doc_id, n from npost")
def read_phrases(spark, sf):
    path = scratch(spark, "phrases")
    IO.write_phrases(*noun_table(spark, sf), path)
    return IO.read_phrases(spark, path)[1]


@query(
    "a03_phrase_rows",
    f"""with {SQL_NOUN_TABLE} select kid, phrase, 0 as part, string_agg(doc_id::varchar, ',' order by doc_id::varchar) as award_ids,
             string_agg(n::varchar, ',' order by doc_id::varchar) as n, 0 as omit, 0 as method, 0 as thematic
        from nkw join npost using (kid) group by 1, 2""",
)
def phrase_rows(spark, sf):
    return IO.phrase_rows(*noun_table(spark, sf))


@query(
    "a03_current_version",
    f"with {SQL_NOUN_TABLE} select kid, phrase, kid::bigint % 3 = 0 as omit, false as method, false as thematic from nkw",
)
def current_version(spark, sf):
    """The table is published, published again with flags set, and a third time by a writer that never announces it."""
    root = scratch(spark, "phrases")
    phrases, postings = noun_table(spark, sf)
    IO.publish_phrases(phrases, postings, root)
    flagged = phrases.withColumn("omit", F.col("kid").cast("long") % 3 == 0)
    IO.publish_phrases(flagged, postings, root)
    IO.write_phrases(phrases.withColumn("thematic", F.lit(True)), postings, versions.fresh_folder(root))
    return IO.current_phrases(spark, root)[0]


@query(
    "a04_read_vectors",
    "select vec_id::varchar as vec_id, len(embedding)::bigint as d, round(embedding[1]::double, 6) as first, round(embedding[64]::double, 6) as last from embeddings",
)
def read_vectors(spark, sf):
    path = scratch(spark, "vectors")
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    IO.write_vectors(v, path, "vec_id", ["label"])
    back = IO.read_vectors(spark, path, "vec_id", ["label"])
    return back.select(
        "vec_id",
        F.size("vec").cast("long").alias("d"),
        F.round(F.get("vec", F.lit(0)), 6).alias("first"),
        F.round(F.get("vec", F.lit(63)), 6).alias("last"),
    )


@query(
    "a05_widen_vectors",
    "select vec_id, round(embedding[1]::double, 6) as dim_1, round(embedding[10]::double, 6) as dim_10 from embeddings",
)
def widen_vectors(spark, sf):
    wide = IO.widen(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")
    return wide.select("vec_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("dim_1", "dim_10")])


def labelled(spark, sf):
    """Every line item as a label: part and supplier as phrases, discount as value."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("kw1"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("kw2"),
        (F.col("l_discount") * 10).alias("value"),
        F.col("l_returnflag").alias("rater"),
    )


SQL_LABELLED = """
lab as (select 'P' || l_partkey as kw1, 'S' || l_suppkey as kw2, l_discount * 10 as value, l_returnflag as rater from lineitem)
"""


@query("a06_read_labels", f"with {SQL_LABELLED} select kw1, kw2, round(value, 6) as value, null::varchar as rater from lab")
def read_labels(spark, sf):
    path = scratch(spark, "labels")
    IO.write_csv(labelled(spark, sf).drop("rater").toDF("a", "b", "c"), path)
    return IO.read_labels(spark, path).withColumn("value", F.round("value", 6))


@query(
    "a07_append_labels",
    f"""with {SQL_LABELLED} select kw1, kw2, round(value, 6) as value, rater from
        (select kw1, kw2, case when rater = 'A' then null else value end as value, 'AB' as rater from lab
         union all select kw1, kw2, value, 'CD' from lab where rater = 'A') where value is not null""",
)
def append_labels(spark, sf):
    path = scratch(spark, "labels")
    sheet = labelled(spark, sf).withColumnsRenamed({"kw1": "keyword 1", "kw2": "keyword 2"})
    first = sheet.withColumn("value", F.when(F.col("rater") != "A", F.col("value")))
    IO.append_labels(first.withColumn("value", F.coalesce("value", F.lit(float("nan")))), path, " ab ")
    IO.append_labels(sheet.filter("rater = 'A'"), path, "cd")
    return IO.read_labels(spark, path).withColumn("value", F.round("value", 6))


@query("a08_tables_json", "select l_returnflag as fold, count(*) as n_edges from lineitem group by 1")
def tables_json(spark, sf):
    path = scratch(spark, "summary")
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("fold")).agg(F.count(F.lit(1)).alias("n_edges"))
    IO.write_json(counts, path)
    return spark.read.schema("fold string, n_edges bigint").json(path)


@query("a09_similarity_edges", f"with {SQL_SIM} select id1, id2, round(cosine, 6) as cosine from sim where cosine > 0.2")
def similarity_edges(spark, sf):
    path = scratch(spark, "edges")
    IO.write_edges(S.similar_pairs(vectors(spark, sf), 0.2), path)
    return spark.read.parquet(path).withColumn("cosine", F.round("cosine", 6))
