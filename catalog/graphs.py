"""Co-occurrence and component-size queries, and the phrase table other modules start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.operators import graph as G
from phrasegraph.operators import phrases as P
from phrasegraph.plans.durable import durable

from .base import query, table
from .phrases import SQL_NORMAL, SQL_NOUN, SQL_SPANS, docs_of

#: Noun-side phrases of ``documents``, numbered in phrase order, and their postings.
SQL_NOUN_TABLE = f"""{SQL_SPANS},{SQL_NORMAL},{SQL_NOUN},
nkw as materialized (select row_number() over (order by phrase)::varchar as kid, phrase, doc_count
        from (select distinct phrase, doc_count from noun)),
npost as materialized (select kid, doc_id, n from nkw join noun using (phrase))
"""


def noun_table(spark, sf):
    spans = P.candidate_phrases(docs_of(spark, sf))
    noun = durable(P.noun_side(P.frequent_postings(durable(P.phrase_doc_counts(spans)))))
    phrases = durable(P.assign_kid(P.doc_counts(noun)))
    postings = noun.join(phrases.select("phrase", "kid"), "phrase").select("kid", "doc_id", "n")
    return phrases, durable(postings)


@query(
    "e03_cooccurrence_phrases",
    f"""with {SQL_NOUN_TABLE} select a.kid as id1, b.kid as id2, count(*) as shared
        from npost a join npost b on a.doc_id = b.doc_id and a.kid < b.kid group by 1, 2""",
)
def cooccurrence_phrases(spark, sf):
    return G.cooccurrence(noun_table(spark, sf)[1])


@query(
    "e03_cooccurrence_parts",
    """with i as (select distinct l_partkey as kid, l_orderkey as doc_id from lineitem)
       select a.kid as id1, b.kid as id2, count(*) as shared from i a join i b on a.doc_id = b.doc_id and a.kid < b.kid group by 1, 2""",
)
def cooccurrence_parts(spark, sf):
    return G.cooccurrence(part_incidence(spark, sf))


@query(
    "e03_frequent_cooccurrence",
    f"""with {SQL_NOUN_TABLE} select a.kid as id1, b.kid as id2, count(*) as shared
        from npost a join npost b on a.doc_id = b.doc_id and a.kid < b.kid group by 1, 2 having count(*) >= 3""",
)
def frequent_phrases(spark, sf):
    return G.frequent_cooccurrence(noun_table(spark, sf)[1], 3)


@query(
    "e03_frequent_parts",
    """with i as (select distinct l_partkey as kid, l_orderkey as doc_id from lineitem)
       select a.kid as id1, b.kid as id2, count(*) as shared from i a join i b on a.doc_id = b.doc_id and a.kid < b.kid
       group by 1, 2 having count(*) >= 2""",
)
def frequent_parts(spark, sf):
    return G.frequent_cooccurrence(part_incidence(spark, sf), 2)


def part_incidence(spark, sf):
    """Part by order incidence: parts are the phrases, orders the documents."""
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_partkey").alias("kid"), F.col("l_orderkey").alias("doc_id"))
        .distinct()
    )


#: Customers and their orders: one component per customer.
SQL_STARS = "ed as (select 'C' || o_custkey as kw1, 'O' || o_orderkey as kw2 from orders)"


def star_edges(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("kw1"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("kw2"),
    )


@query(
    "e04_component_sizes",
    f"with {SQL_STARS} select kw1 as component, count(distinct kw2) + 1 as n_nodes, count(*) as n_edges from ed group by 1",
)
def component_sizes(spark, sf):
    edges = star_edges(spark, sf)
    return G.component_sizes(G.connected_components(edges, "kw1", "kw2"), edges, "kw1")


@query(
    "e04_size_summary",
    f"""with {SQL_STARS} select count(*) as n_components, median(n)::double as median_nodes
        from (select kw1, count(distinct kw2) + 1 as n from ed group by 1)""",
)
def size_summary(spark, sf):
    return G.size_summary(component_sizes(spark, sf))
