"""The generic relational steps of the pipeline, on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phrasegraph.operators import checks
from phrasegraph.operators.evaluation import right_closed_bin
from phrasegraph.plans.durable import durable
from phrasegraph.plans.ordering import (
    dense_index,
    exact_quantiles,
    running_total,
    share_of_total,
    with_average_rank,
)

from .base import query, table


@query(
    "g01_filter",
    """select o_orderkey, o_totalprice from orders where o_orderpriority is not null and length(o_orderpriority) > 0
       and o_totalprice between 1000 and 200000 and o_orderstatus in ('O', 'F')""",
)
def filter_rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(
        F.col("o_orderpriority").isNotNull()
        & (F.length("o_orderpriority") > 0)
        & F.col("o_totalprice").between(1000, 200000)
        & F.col("o_orderstatus").isin("O", "F")
    ).select("o_orderkey", "o_totalprice")


@query(
    "g02_project",
    """select l_orderkey::varchar as okey, l_linenumber as line, case when l_quantity > 25 then 'big' else 'small' end as kind,
              l_discount * 10 as value from lineitem""",
)
def project(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("okey"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("kind"),
        (F.col("l_discount") * 10).alias("value"),
    )


@query(
    "g03_left_join",
    "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey",
)
def left_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query(
    "g04_full_join_priority",
    """select coalesce(l.doc_id, d.doc_id) as doc_id, coalesce(l.quality, 9) as quality,
              case when l.doc_id is null then 'documents' when d.doc_id is null then 'labels' else 'both' end as source
       from labels l full join documents d on l.doc_id = d.doc_id""",
)
def full_join(spark, sf):
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    a = l.select("doc_id", "quality", F.lit(1).alias("_l"))
    b = d.select("doc_id", F.lit(1).alias("_d"))
    source = F.when(F.col("_l").isNull(), "documents").when(F.col("_d").isNull(), "labels").otherwise("both")
    return a.join(b, "doc_id", "full").select(
        "doc_id", F.coalesce("quality", F.lit(9)).alias("quality"), source.alias("source")
    )


@query("g05_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_join(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey")


@query("g06_anti_join", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    "g07_key_lookup",
    "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
)
def key_lookup(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select("o_orderkey", "n_name")


@query(
    "g08_aggregate",
    """select l_returnflag, count(*) as n, round(sum(l_quantity), 6) as total, round(avg(l_extendedprice), 6) as mean,
              round(stddev_samp(l_discount), 6) as sd, min(l_tax) as lo, max(l_tax) as hi, median(l_quantity) as mid,
              count(distinct l_suppkey) as suppliers
       from lineitem group by 1""",
)
def aggregate(spark, sf):
    li = table(spark, sf, "lineitem")
    # The median is taken over counted values: one row per distinct quantity.
    per_value = li.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("_n"))
    mids = per_value.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5), F.col("_n")).alias("mid"))
    rest = li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 6).alias("total"),
        F.round(F.avg("l_extendedprice"), 6).alias("mean"),
        F.round(F.stddev_samp("l_discount"), 6).alias("sd"),
        F.min("l_tax").alias("lo"),
        F.max("l_tax").alias("hi"),
        F.count_distinct("l_suppkey").alias("suppliers"),
    )
    return rest.join(mids, "l_returnflag")


@query(
    "g09_distinct",
    "select l_partkey, l_suppkey, min(l_orderkey) as first_order from lineitem group by 1, 2",
)
def distinct(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    # distinct with all columns kept: the smallest order stands for the pair.
    return li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))


@query("g10_sort", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")
def sort(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("g11_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "g12_row_number",
    "select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn from conversations",
)
def row_number(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.row_number().over(w).cast("long").alias("rn")
    )


@query("g13_dense_index", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as idx from orders")
def global_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return dense_index(o, ["o_totalprice", "o_orderkey"], "idx").select("o_orderkey", "idx")


@query(
    "g14_average_rank",
    """select event_id, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rnk
       from events where value is not null""",
)
def average_rank(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value").filter("value is not null")
    return with_average_rank(ev, "value", "rnk").select("event_id", "rnk")


@query(
    "g15_union_all",
    "select l_partkey as id, l_quantity as q, null::double as p from lineitem union all select o_orderkey, null, o_totalprice from orders",
)
def union_all(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("q"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "g16_intersect_except",
    """select id, 'both' as side from (select l_suppkey as id from lineitem intersect select s_suppkey from supplier)
       union all select id, 'left' from (select p_partkey as id from part except select l_partkey from lineitem)""",
)
def intersect_except(spark, sf):
    li = table(spark, sf, "lineitem")
    both = li.select(F.col("l_suppkey").alias("id")).intersect(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    left = parts.join(li.select(F.col("l_partkey").alias("id")), "id", "left_anti").distinct()
    return both.withColumn("side", F.lit("both")).unionByName(left.withColumn("side", F.lit("left")))


@query(
    "g17_explode_collapse",
    """with e as (select item_id, generate_subscripts(w, 1) as pos, unnest(w) as part from
           (select item_id, string_split(text, ', ') as w from benchmark))
       select item_id, string_agg(part, '|' order by pos desc) as reversed, count(*) as parts from e group by 1""",
)
def explode_collapse(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", ", ")).alias("pos", "part"))
    # A group is one text's own parts, so the list is no longer than the text.
    lists = rows.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "part")), asc=False).alias("l"), F.count(F.lit(1)).alias("parts")
    )
    return lists.select("item_id", F.concat_ws("|", "l.part").alias("reversed"), "parts")


@query(
    "g18_pivot",
    """select l_returnflag, count(*) filter (l_linestatus = 'F') as f, count(*) filter (l_linestatus = 'O') as o
       from lineitem group by 1""",
)
def pivot(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)
    return out.withColumnsRenamed({"F": "f", "O": "o"})


@query(
    "g19_complete",
    """select r.event_type, d.fold, count(e.event_id) as n
       from (select distinct event_type from events) r, (select unnest(generate_series(1, 12)) as fold) d
       left join events e on e.event_type = r.event_type and 1 + e.user_id % 10 = d.fold group by 1, 2""",
)
def complete(spark, sf):
    ev = table(spark, sf, "events").withColumn("fold", 1 + F.col("user_id") % 10)
    counts = ev.groupBy("event_type", "fold").agg(F.count(F.lit(1)).alias("n"))
    # Every fold of a fixed list is added to each type; only types and folds multiply.
    grid = ev.select("event_type").distinct().select(
        "event_type", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("fold")
    )
    return grid.join(counts, ["event_type", "fold"], "left").fillna(0, ["n"])


@query(
    "g20_fixed_bins",
    """select case when l_discount > 0 and l_discount <= 0.02 then 1 when l_discount > 0.02 and l_discount <= 0.04 then 2
              when l_discount > 0.04 and l_discount <= 0.06 then 3 when l_discount > 0.06 and l_discount <= 0.08 then 4
              when l_discount > 0.08 and l_discount <= 0.1 then 5 end as bin, count(*) as n from lineitem group by 1""",
)
def fixed_bins(spark, sf):
    number = right_closed_bin(F.col("l_discount"), [0.0, 0.02, 0.04, 0.06, 0.08, 0.1])
    return table(spark, sf, "lineitem").groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g21_exact_quantiles",
    """select p as prob, round(q, 6) as value from (select unnest([0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]::double[]) as p,
       unnest(quantile_cont(o_totalprice, [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1])) as q from orders)""",
)
def quantiles(spark, sf):
    out = exact_quantiles(table(spark, sf, "orders"), "o_totalprice", [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1])
    return out.withColumn("value", F.round("value", 6))


@query(
    "g22_pearson",
    "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1",
)
def pearson(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r")
    )


@query(
    "g23_prefix_sum",
    """select o_orderkey, round(sum(c) over (order by o_orderkey rows unbounded preceding), 6)::bigint as upto
       from (select l_orderkey as o_orderkey, count(*) as c from lineitem group by 1)""",
)
def prefix_sum(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c"))
    return running_total(counts, ["o_orderkey"], "c", "upto").select("o_orderkey", "upto")


@query(
    "g24_share_of_total",
    """select l_suppkey, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from lineitem group by 1""",
)
def share(spark, sf):
    counts = durable(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")))
    return share_of_total(counts, "n", "share").withColumn("share", F.round("share", 9))


@query(
    "g25_violations",
    """select sum(n)::bigint as n_rows, count(*) filter (n > 1 and l_orderkey is not null) as repeated_keys,
              sum(b)::bigint as null_l_shipdate
       from (select l_orderkey, count(*) as n, count(*) filter (l_shipdate is null) as b from lineitem group by 1)""",
)
def violations(spark, sf):
    return checks.violations(table(spark, sf, "lineitem"), "l_orderkey", ["l_shipdate"])
