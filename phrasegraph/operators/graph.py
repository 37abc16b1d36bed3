"""Undirected graphs as edge DataFrames: components, sizes, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, steps
from ..plans.ordering import dense_index
from ..plans.skew import grouped_pairs, lookup


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _ends(links: DataFrame) -> DataFrame:
    """``a, b``: both directions of every link."""
    return links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        links.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    """Point every larger neighbour of a vertex at the smallest vertex it can see."""
    both = _ends(links)
    mins = both.groupBy("a").agg(
        F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("_n")
    )
    return (
        lookup(both, mins, ["a"], "_n", 2 * n_links)
        .filter("b > a")
        .select(F.col("b").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    """Point a vertex and its smaller neighbours at the smallest of them."""
    mins = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    moved = lookup(links, mins, ["u"], "_n", n_links).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return (
        moved.filter("u <> v")
        .unionByName(mins.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` for every vertex with an edge; the label is the smallest member.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is a few
    joins; its result goes to the checkpoint folder, so lineage stays short, and the round
    before is deleted. Vertices with one neighbour take no part in the rounds: they follow it.
    """
    with steps(edges.sparkSession) as scope:
        links = durable(
            edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
            .filter("u <> v")
            .distinct()
        )
        seen = _fingerprint(links)
        verts = durable(_ends(links).groupBy("a").agg(F.count(F.lit(1)).alias("_deg"), F.min("b").alias("b")))
        leaves = verts.filter("_deg = 1").drop("_deg")
        inner = None
        if 2 * leaves.count() > seen[0]:
            hosts = leaves.groupBy("b").agg(F.min("a").alias("_least"), F.count(F.lit(1)).alias("_leaves"))
            inner = verts.filter("_deg > 1").select(F.col("a").alias("b"), "_deg").join(hosts, "b", "left").fillna(0, ["_leaves"])
            inner = durable(inner.withColumn("_rep", F.least("b", "_least")))
            # A vertex stands for its leaves: its name is their smallest.
            reps = inner.filter("_deg > _leaves").withColumn("_n", F.col("_deg") - F.col("_leaves"))
            if reps.isEmpty():
                links, seen = links.limit(0), (0,)
            else:
                for end in ("u", "v"):
                    named = reps.select(F.col("b").alias(end), F.col("_rep").alias(f"_{end}"), "_n")
                    links = lookup(links, named, [end], "_n")
                links = durable(links.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")))
                seen = _fingerprint(links)
        while seen[0]:
            # Neither step adds links: large-star rewrites each, small-star keeps their number.
            before, links = links, durable(_small_star(_large_star(links, seen[0]), seen[0]))
            scope.drop(before)
            now = _fingerprint(links)
            if now == seen:
                break
            seen = now
        members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
        found = members.unionByName(roots)
        if inner is None:
            return scope.keep(found)
        placed = inner.join(found.select(F.col("id").alias("_rep"), "component"), "_rep", "left")
        placed = durable(placed.select("b", F.coalesce("component", "_rep").alias("component"), "_leaves"))
        # The host of a leaf is a leaf itself where two vertices have only each other.
        following = lookup(leaves, placed.filter("_leaves > 0"), ["b"], "_leaves", how="left")
        led = following.select(F.col("a").alias("id"), F.coalesce("component", F.least("a", "b")).alias("component"))
        return scope.keep(placed.select(F.col("b").alias("id"), "component").unionByName(led))


def survivors(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep the smallest document of each component and every isolated one."""
    losers = components.filter("id <> component").select(F.col("id").alias(id_col))
    return docs.join(losers, id_col, "left_anti")


def retention(n_all: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before and after, and the percentage retained."""
    before = n_all.agg(F.count(F.lit(1)).alias("n_before"))
    after = kept.agg(F.count(F.lit(1)).alias("n_after"))
    pct = F.when(F.col("n_before") > 0, 100.0 * F.col("n_after") / F.col("n_before"))
    return before.join(F.broadcast(after)).withColumn("retained_pct", pct)


def component_sizes(components: DataFrame, edges: DataFrame, src: str = "src") -> DataFrame:
    """``component, n_nodes, n_edges``; parallel edges count."""
    nodes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    per_vertex = edges.groupBy(F.col(src).alias("id")).agg(F.count(F.lit(1)).alias("_e"))
    per_component = (
        per_vertex.join(components, "id").groupBy("component").agg(F.sum("_e").alias("n_edges"))
    )
    return nodes.join(per_component, "component", "left").fillna(0, ["n_edges"])


def size_summary(sizes: DataFrame) -> DataFrame:
    """Number of components and median node count; sizes are pre-counted per value."""
    per_size = sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("_n"))
    return per_size.agg(
        F.sum("_n").alias("n_components"),
        F.percentile("n_nodes", F.lit(0.5), F.col("_n")).alias("median_nodes"),
    )


def cooccurrence(
    incidence: DataFrame, id_col: str = "kid", doc_col: str = "doc_id", block_rows: int = 512
) -> DataFrame:
    """Shared-document counts ``id1 < id2, shared``; absent pairs share nothing.

    Every pair inside a document is part of the answer. Documents with many phrases are cut
    into blocks, so no task sees one whole, and pair counts combine before their shuffle.
    """
    pairs = grouped_pairs(
        incidence.select(doc_col, id_col).distinct(), doc_col, id_col, [], block_rows=block_rows
    )
    return pairs.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("shared"))


def frequent_cooccurrence(
    incidence: DataFrame, min_shared: int, id_col: str = "kid", doc_col: str = "doc_id", block_rows: int = 512
) -> DataFrame:
    """``id1 < id2, shared`` of the pairs that share at least ``min_shared`` documents.

    Phrases with fewer documents go first. The pairs of each document are counted as they are met. Only in a document with more
    than ``block_rows`` phrases, half of them late, late phrases are left out: a phrase is late in its last ``min_shared - 1``
    documents, those with few phrases coming first. Two phrases that share enough are late together nowhere
    in the first document they share, so the pair is met; what it shares in the documents cut is then added.
    """
    if min_shared < 1:
        raise ValueError("min_shared must be at least 1")
    rows = durable(incidence.select(doc_col, id_col).filter(F.col(doc_col).isNotNull() & F.col(id_col).isNotNull()).distinct())
    kept = rows
    if min_shared > 1:
        sizes = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_shared)
        kept = durable(lookup(rows, sizes, [id_col], "_n"))
    width = kept.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_width"))
    wide = durable(width.filter(F.col("_width") > block_rows))
    late = cut = None
    if min_shared > 1 and not wide.isEmpty():
        # Documents with few phrases come first, so those left out of the numbering precede all that are in it.
        placed = durable(
            dense_index(lookup(kept, wide.withColumn("_n", F.col("_width")), [doc_col], "_n"), [id_col, "_width", doc_col], "_at")
        )
        last = placed.groupBy(id_col).agg(F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
        flagged = lookup(placed, last, [id_col], "_n").withColumn("_late", F.col("_last") - F.col("_at") < min_shared - 1)
        flagged = durable(flagged.select(doc_col, id_col, "_late"))
        halves = flagged.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_late").alias("_l"))
        cut = durable(lookup(flagged, halves.filter("2 * _l >= _n").drop("_l"), [doc_col], "_n"))
        late = cut.filter("_late").drop("_late")
        if late.isEmpty():
            cut = None
    met = kept.select(doc_col, id_col)
    if cut is not None:
        met = met.join(late, [doc_col, id_col], "left_anti")
    counted = cooccurrence(met, id_col, doc_col, block_rows)
    if cut is not None:
        counted = durable(counted)
        # A document where both are late counts once, from the first phrase.
        more = [
            counted.select("id1", "id2")
            .join(late.select(F.col(id_col).alias(one), doc_col), one)
            .join(other.select(F.col(id_col).alias(two), doc_col), [two, doc_col])
            .groupBy("id1", "id2")
            .agg(F.count(F.lit(1)).alias("shared"))
            for one, two, other in (("id1", "id2", cut), ("id2", "id1", cut.filter("not _late")))
        ]
        counted = counted.unionByName(more[0]).unionByName(more[1]).groupBy("id1", "id2").agg(F.sum("shared").alias("shared"))
    return counted.filter(F.col("shared") >= min_shared)


def shared_documents(
    pairs: DataFrame, incidence: DataFrame, id_col: str = "kid", doc_col: str = "doc_id"
) -> DataFrame:
    """``shared`` for the given pairs only (0 if none).

    Only phrases that occur in a pair take part. Either the smaller posting list of each pair is expanded and probed in
    the larger one by an equi-join on (phrase, document), or the pairs of each document are counted as in
    ``cooccurrence``, whichever makes fewer rows; both numbers are counted first.
    """
    pairs = durable(pairs)
    wanted = pairs.select("id1", "id2").distinct()
    used = wanted.select(F.explode(F.array("id1", "id2")).alias(id_col)).distinct()
    rows = durable(incidence.select(id_col, doc_col).join(used, id_col, "left_semi").distinct())
    sizes = durable(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")))
    first = sizes.select(F.col(id_col).alias("id1"), F.col("_n").alias("_n1"))
    second = sizes.select(F.col(id_col).alias("id2"), F.col("_n").alias("_n2"))
    sized = durable(wanted.join(first, "id1").join(second, "id2"))
    width = rows.filter(F.col(doc_col).isNotNull()).groupBy(doc_col).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    met = width.agg(F.sum(F.col("_w") * (F.col("_w") - 1) / 2)).first()[0] or 0.0
    expanded = sized.agg(F.sum(F.least("_n1", "_n2").cast("double"))).first()[0] or 0.0
    if met < expanded:
        counts = cooccurrence(rows, id_col, doc_col).select(F.col("id1").alias("_a"), F.col("id2").alias("_b"), "shared")
        apart = sized.select("id1", "id2", F.least("id1", "id2").alias("_a"), F.greatest("id1", "id2").alias("_b"))
        # A phrase shares all its documents with itself; a document that is null is none.
        alone = rows.filter(F.col(doc_col).isNotNull()).groupBy(F.col(id_col).alias("_a")).agg(F.count(F.lit(1)).alias("shared"))
        itself = apart.filter("_a = _b").join(alone, "_a").select("id1", "id2", "shared")
        hits = apart.join(counts, ["_a", "_b"]).select("id1", "id2", "shared").unionByName(itself)
    else:
        swap = F.col("_n2") < F.col("_n1")
        probes = sized.select(
            "id1",
            "id2",
            F.when(swap, F.col("id2")).otherwise(F.col("id1")).alias("_small"),
            F.when(swap, F.col("id1")).otherwise(F.col("id2")).alias("_large"),
        )
        small = rows.select(F.col(id_col).alias("_small"), doc_col)
        large = rows.select(F.col(id_col).alias("_large"), doc_col)
        hits = (
            probes.join(small, "_small")
            .join(large, ["_large", doc_col])
            .groupBy("id1", "id2")
            .agg(F.count(F.lit(1)).alias("shared"))
        )
    return pairs.join(hits, ["id1", "id2"], "left").fillna(0, ["shared"])
