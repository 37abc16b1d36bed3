"""Fold-split queries.

Two graphs, both from whole tables: customers with their orders (many small components) and
parts with their suppliers (one large component). Where the packing itself has no SQL form,
the surrounding steps run on blocks and folds derived from the keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.operators import folds as FO
from phrasegraph.operators.communities import communities, community_checks, modularity
from phrasegraph.operators.graph import component_sizes, connected_components
from phrasegraph.plans.durable import durable

from .base import query, table
from .graphs import SQL_STARS, star_edges
from .sources import SQL_LABELLED, labelled

SQL_EDGES = f"""{SQL_LABELLED},
ed as materialized (select distinct least(kw1, kw2) as kw1, greatest(kw1, kw2) as kw2, value, rater from lab)
"""
#: Blocks and folds given by the key: 20 blocks, 5 folds.
SQL_GIVEN = f"""{SQL_EDGES},
nd as (select kw as keyword, 1 + substr(kw, 2)::bigint % 20 as block_id from (select kw1 as kw from ed union select kw2 from ed)),
bl as (select block_id, count(*) as n_nodes from nd group by 1),
fo as (select block_id, (1 + block_id % 5)::int as fold from bl),
tg as materialized (select ed.*, a.block_id as block1, b.block_id as block2 from ed join nd a on a.keyword = kw1 join nd b on b.keyword = kw2),
cp as (select least(block1, block2) as b1, greatest(block1, block2) as b2, count(*) as w from tg where block1 <> block2 group by 1, 2),
nb as (select b1 as block_id, b2 as nb, w from cp union all select b2, b1, w from cp),
st as (select block_id, n_nodes, coalesce(i.n, 0) as n_edges_intra, coalesce(c.n, 0)::bigint as n_edges_cut_touching
       from bl left join (select block1 as block_id, count(*) as n from tg where block1 = block2 group by 1) i using (block_id)
       left join (select block_id, sum(w) as n from nb group by 1) c using (block_id)),
kf as (select keyword, fold from nd join fo using (block_id)),
wf as materialized (select ed.*, a.fold as fold1, b.fold as fold2 from ed join kf a on a.keyword = kw1 join kf b on b.keyword = kw2)
"""


def edges(spark, sf):
    return FO.canonical_edges(labelled(spark, sf))


def given(spark, sf):
    """Edges, nodes, blocks and folds of the key-derived split."""
    ed = durable(edges(spark, sf))
    kws = ed.select(F.col("kw1").alias("keyword")).union(ed.select(F.col("kw2").alias("keyword"))).distinct()
    nodes = durable(kws.withColumn("block_id", 1 + F.substring("keyword", 2, 20).cast("long") % 20))
    blocks = nodes.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    folds = blocks.select("block_id", (1 + F.col("block_id") % 5).cast("int").alias("fold"))
    return ed, nodes, blocks, folds


def tagged(spark, sf):
    ed, nodes, blocks, _ = given(spark, sf)
    return FO.tag_edges(ed, nodes), blocks


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("f01_canonical_edges", f"with {SQL_EDGES} select kw1, kw2, round(value, 6) as value, rater from ed")
def canonical_edges(spark, sf):
    return rounded(edges(spark, sf), "value")


@query(
    "f02_large_components",
    f"""with {SQL_STARS}, s as (select kw1 as component, count(*) + 1 as n_nodes, count(*) as n_edges from ed group by 1)
        select component, n_nodes, n_edges from s where n_nodes >= 16 or n_edges >= 100""",
)
def large_components(spark, sf):
    ed = star_edges(spark, sf)
    sizes = component_sizes(connected_components(ed, "kw1", "kw2"), ed, "kw1")
    return FO.large_components(sizes, 16, 100)


def found_communities(spark, sf):
    ed = durable(edges(spark, sf).select("kw1", "kw2"))
    return ed, communities(ed, connected_components(ed, "kw1", "kw2"), "kw1", "kw2")


@query("f03_communities")
def f03_communities(spark, sf):
    return found_communities(spark, sf)[1]


@query("f03_found_modularity")
def found_modularity(spark, sf):
    return modularity(*found_communities(spark, sf), "kw1", "kw2")


@query(
    "f03_community_checks",
    f"""with {SQL_EDGES} select count(*) as n_vertices, 0::bigint as n_spanning, 0::bigint as n_disconnected, 0::bigint as n_misnamed
        from (select kw1 as kw from ed union select kw2 from ed)""",
)
def f03_community_checks(spark, sf):
    """Every vertex has a community, named by its smallest member, connected, inside one component."""
    ed, labels = found_communities(spark, sf)
    return community_checks(ed, connected_components(ed, "kw1", "kw2"), labels, "kw1", "kw2")


@query(
    "f03_modularity",
    f"""with {SQL_GIVEN}, c as (select block_id, n_edges_intra as i, 2 * n_edges_intra + n_edges_cut_touching as t from st),
             m as (select sum(t) as m2 from c)
        select round(sum(2.0 * i / m2 - (t / m2::double) ** 2), 6) as modularity from c, m""",
)
def f03_modularity(spark, sf):
    ed, nodes, _, _ = given(spark, sf)
    labels = nodes.select(F.col("keyword").alias("id"), F.col("block_id").alias("community"))
    return rounded(modularity(ed, labels, "kw1", "kw2"), "modularity")


_SQL_STAR_BLOCKS = f"""{SQL_STARS}, bl as (select row_number() over (order by kw1) as block_id, kw1, count(*) as n from ed group by kw1)"""


@query(
    "f04_assign_blocks",
    f"""with {_SQL_STAR_BLOCKS} select block_id, block_id as orig_comp_id, 'component' as block_type, n + 1 as n_nodes from bl""",
)
def assign_blocks(spark, sf):
    return FO.assign_blocks(star_edges(spark, sf))[1]


@query(
    "f04_block_members",
    f"""with {_SQL_STAR_BLOCKS} select kw1 as keyword, block_id from bl union all
        select kw2, block_id from ed join bl using (kw1)""",
)
def block_members(spark, sf):
    return FO.assign_blocks(star_edges(spark, sf))[0]


@query(
    "f05_tag_edges",
    f"with {SQL_GIVEN} select kw1, kw2, round(value, 6) as value, rater, block1, block2 from tg",
)
def tag_edges(spark, sf):
    return rounded(tagged(spark, sf)[0], "value")


@query(
    "f06_block_stats",
    f"""with {SQL_GIVEN} select block_id, n_nodes, n_edges_intra, n_edges_cut_touching,
             case when (select max(n_edges_intra) from st) > 0 then n_edges_intra else n_nodes end as weight,
             n_edges_cut_touching as cross_degree, n_edges_intra + n_edges_cut_touching as strength from st""",
)
def block_stats(spark, sf):
    tg, blocks = tagged(spark, sf)
    return FO.block_stats(blocks, durable(tg))


@query(
    "f07_score_breaks",
    f"""with {SQL_EDGES} select unnest(list_distinct(quantile_cont(round(value, 6), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as brk from ed""",
)
def score_breaks(spark, sf):
    found = FO.score_breaks(rounded(edges(spark, sf), "value"), "value")
    return spark.createDataFrame([(b,) for b in found], "brk double")


@query(
    "f08_score_histogram",
    f"""with {SQL_GIVEN}, q as (select list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as e from ed),
             b as (select block1 as block_id, greatest(1, len(list_filter(e, lambda t: t < value))) as bin from tg, q where block1 = block2)
        select bl.block_id, {', '.join(f'count(*) filter (bin = {i}) as bin_{i}' for i in range(1, 11))}
        from bl left join b using (block_id) group by 1""",
)
def score_histogram(spark, sf):
    tg, blocks = tagged(spark, sf)
    breaks = FO.score_breaks(edges(spark, sf), "value")
    out = FO.score_histogram(FO.intra_edges(tg), blocks, "value", breaks)
    missing = [F.lit(0).cast("long").alias(f"bin_{i}") for i in range(len(breaks), 11)]
    return out.select("*", *missing)


@query("f09_cross_pairs", f"with {SQL_GIVEN} select b1, b2, w from cp")
def cross_pairs(spark, sf):
    return FO.cross_pairs(tagged(spark, sf)[0])


@query("f09_neighbours", f"with {SQL_GIVEN} select block_id, nb, w from nb")
def neighbours(spark, sf):
    return FO.neighbours(FO.cross_pairs(tagged(spark, sf)[0]))


@query("f10_pack_components")
def pack_components(spark, sf):
    """Folds of the customer components."""
    return FO.split(star_edges(spark, sf))["blocks"]


@query("f10_pack_communities")
def pack_communities(spark, sf):
    """Folds of the communities of the part-supplier graph."""
    return FO.split(labelled(spark, sf))["blocks"]


@query(
    "f10_exchange_checks",
    """select count(distinct o_custkey) as n_blocks, count(*) as n_edges, 0::bigint as n_reweighted, true as not_worse,
             true as one_fold_each from orders""",
)
def exchange_checks(spark, sf):
    """Customers packed by their orders, then exchanged until total prices are spread alike: weights stay, distance falls."""
    scored = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("kw1"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("kw2"),
        F.col("o_totalprice").cast("double").alias("value"),
    )
    ed = durable(FO.canonical_edges(scored))
    nodes, blocks = FO.assign_blocks(ed)
    tg = durable(FO.tag_edges(ed, durable(nodes)))
    stats, cross = durable(FO.block_stats(blocks, tg)), durable(FO.cross_pairs(tg))
    breaks = FO.score_breaks(ed, "value")
    histogram = durable(FO.score_histogram(FO.intra_edges(tg), blocks, "value", breaks))
    packed = durable(FO.pack_blocks(stats, cross, 3))
    moved = FO.exchange_blocks(packed, stats, histogram, cross, 3, 0.5)
    before = FO.histogram_distance(FO.fold_bins(packed, histogram, 3))
    after = FO.histogram_distance(FO.fold_bins(moved, histogram, 3))
    old, new = FO.fold_weights(packed, stats, cross), FO.fold_weights(moved, stats, cross)
    changed = old.join(new.withColumnRenamed("weight", "w"), "fold", "full").agg(
        F.count_if(~F.col("weight").eqNullSafe(F.col("w"))).alias("n_reweighted")
    )
    per_block = moved.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_block.agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.max("n") == 1, F.lit(True)).alias("one_fold_each"))
    n_edges = ed.agg(F.count(F.lit(1)).alias("n_edges"))
    return (
        counted.join(F.broadcast(n_edges))
        .join(F.broadcast(changed))
        .withColumn("not_worse", F.lit(after <= before))
    )


@query("f11_keyword_folds", f"with {SQL_GIVEN} select keyword, fold from kf")
def keyword_folds(spark, sf):
    _, nodes, _, folds = given(spark, sf)
    return FO.keyword_folds(nodes, folds)


def fold_edges(spark, sf):
    ed, nodes, _, folds = given(spark, sf)
    return FO.with_folds(ed, durable(FO.keyword_folds(nodes, folds)))


@query(
    "f12_kept_pairs",
    f"with {SQL_GIVEN} select kw1, kw2, round(value, 6) as value, rater, fold1 as fold from wf where fold1 = fold2",
)
def kept_pairs(spark, sf):
    return rounded(FO.kept_pairs(fold_edges(spark, sf)), "value")


@query(
    "f12_cut_summary",
    f"""with {SQL_GIVEN} select count(*) as n_edges, count(*) filter (fold1 <> fold2) as n_cut,
             round(count(*) filter (fold1 <> fold2) / count(*), 6) as cut_ratio from wf""",
)
def cut_summary(spark, sf):
    return rounded(FO.cut_summary(fold_edges(spark, sf)), "cut_ratio")


@query(
    "f13_symmetrize",
    f"""with {SQL_GIVEN}, k as (select kw1, kw2, round(value, 6) as value, rater, fold1 as fold from wf where fold1 = fold2)
        select * from k union all select kw2, kw1, value, rater, fold from k""",
)
def symmetrize(spark, sf):
    return rounded(FO.symmetrize(FO.kept_pairs(fold_edges(spark, sf))), "value")


@query(
    "f14_block_table",
    f"""with {SQL_GIVEN} select block_id as comp_id, 1 as orig_comp_id, 'community' as block_type, n_nodes, n_edges_intra as n_edges,
             n_edges_cut_touching, n_edges_intra as weight, fold from st join fo using (block_id)""",
)
def block_table(spark, sf):
    ed, nodes, blocks, folds = given(spark, sf)
    stats = FO.block_stats(blocks, durable(FO.tag_edges(ed, nodes)))
    meta = stats.withColumn("orig_comp_id", F.lit(1)).withColumn("block_type", F.lit("community"))
    return FO.block_table(meta, folds)


@query(
    "f15_fold_summary",
    f"""with {SQL_GIVEN}, e as (select fold1 as fold, count(*) as n_edges from wf where fold1 = fold2 group by 1),
             s as (select f::int as fold, coalesce(n_edges, 0) as n_edges from (select unnest(generate_series(1, 6)) as f) left join e on f = fold)
        select fold, n_edges, n_edges as weight, round(n_edges / sum(n_edges) over (), 6) as edges_share,
               round(n_edges / sum(n_edges) over (), 6) as weight_share from s""",
)
def fold_summary(spark, sf):
    ed, nodes, blocks, folds = given(spark, sf)
    tg = durable(FO.tag_edges(ed, nodes))
    weights = FO.fold_weights(folds, FO.block_stats(blocks, tg), FO.cross_pairs(tg))
    kept = FO.kept_pairs(FO.with_folds(ed, durable(FO.keyword_folds(nodes, folds))))
    return rounded(FO.fold_summary(kept, weights, 6), "edges_share", "weight_share")


@query("f15_split_summary")
def split_summary(spark, sf):
    """Summary of the whole split of the customer components."""
    return FO.split(star_edges(spark, sf))["summary"]
