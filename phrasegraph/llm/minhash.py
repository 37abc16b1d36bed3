"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.durable import durable, settled, steps
from ..plans.skew import lookup, within_reach
from .common import fixed_words, lists, mix64, slices, small_batches, text_of, utf8_bytes
from .shingles import text_shingles

#: Shingles hashed at a time.
BLOCK = 1 << 18

#: Marks an id that is null: below every other.
_NO_ID = -(2**63)


@dataclass(frozen=True)
class Tensor:
    """Two collections of ``rows`` keys of ``width`` minhashes; a table pairs one key of each.

    ``rows ** 2`` tables with keys of ``2 * width`` minhashes cost ``2 * rows * width`` minhashes
    instead of ``2 * width * rows ** 2``. Texts of similarity s share a table with probability
    ``(1 - (1 - s ** width) ** rows) ** 2``.
    """

    rows: int
    width: int

    @staticmethod
    def reaching(similarity: float, recall: float, width: int = 2) -> Tensor:
        miss = 1 - math.sqrt(recall)
        return Tensor(max(1, math.ceil(math.log(miss) / math.log(1 - similarity**width))), width)


def signatures(docs: DataFrame, size: int, tensor: Tensor) -> DataFrame:
    """``_id, n_shingles, _s1, _s2, _a, _b`` of ``docs(_id, _t)``: set size, set digest, table half-keys."""
    per_side = tensor.rows * tensor.width
    seeds = fixed_words(21, 2 * per_side)
    factors = fixed_words(22, 2 * per_side) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = utf8_bytes(batch.column(1))
            found, made = text_shingles(data, offsets, size)
            bounds = np.concatenate([[0], np.cumsum(made)])
            n = np.zeros(len(made), np.int64)
            digest = np.zeros((2, len(made)), np.uint64)
            lows = np.full((2 * per_side, len(made)), np.iinfo(np.uint64).max, np.uint64)
            for i in np.flatnonzero(made):
                one = np.unique(found[bounds[i] : bounds[i + 1]])
                n[i] = len(one)
                digest[0, i] = mix64(one + np.uint64(1)).sum(dtype=np.uint64)
                digest[1, i] = mix64(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
            full = np.flatnonzero(made)
            begins = bounds[:-1][full]
            for lo in range(0, len(found), BLOCK):
                piece = found[lo : lo + BLOCK]
                a = int(np.searchsorted(begins, lo, "right")) - 1
                b = int(np.searchsorted(begins, lo + len(piece), "left"))
                cuts = np.maximum(begins[a:b] - lo, 0)
                rows = full[a:b]
                for h in range(2 * per_side):
                    low = np.minimum.reduceat((piece ^ seeds[h]) * factors[h], cuts)
                    lows[h, rows] = np.minimum(lows[h, rows], low)
            sides = []
            for side in range(2):
                keys = np.empty((tensor.rows, len(made)), np.uint64)
                for r in range(tensor.rows):
                    first = side * per_side + r * tensor.width
                    key = np.full(len(made), r + 1, np.uint64)
                    for w in range(tensor.width):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + lows[first + w])
                    keys[r] = key
                flat = np.ascontiguousarray(keys.T[made > 0]).reshape(-1).view(np.int64)
                sides.append(lists(flat, np.where(made > 0, tensor.rows, 0), pa.int64()))
            yield pa.record_batch(
                [batch.column(0), pa.array(n), *[pa.array(d.view(np.int64)) for d in digest], *sides],
                ["_id", "n_shingles", "_s1", "_s2", "_a", "_b"],
            )

    schema = "_id long, n_shingles long, _s1 long, _s2 long, _a array<long>, _b array<long>"
    return docs.select("_id", "_t").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``_id, _set`` of ``docs(_id, _t)``: the sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = utf8_bytes(batch.column(1))
            found, made = text_shingles(data, offsets, size)
            bounds = np.concatenate([[0], np.cumsum(made)])
            for lo in range(0, len(made), 256):
                hi = min(lo + 256, len(made))
                sets = [np.unique(found[bounds[i] : bounds[i + 1]]).tobytes() for i in range(lo, hi)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["_id", "_set"])

    return docs.select("_id", "_t").mapInArrow(run, "_id long, _set binary")


def compared(pairs: DataFrame, sets: DataFrame, deltas: bool = False) -> DataFrame:
    """``id1, id2, same, n1, n2`` for ``pairs(id1, id2)``: exact overlap and sizes of the full sets.

    With ``deltas`` also ``novel`` and ``missing``: the shingles of id2 that id1 lacks, and the reverse.
    """
    first = sets.select(F.col("_id").alias("id1"), F.col("_set").alias("_set1"))
    second = sets.select(F.col("_id").alias("id2"), F.col("_set").alias("_set2"))
    # Many pairs may share a leader id1; its set is one row, so Spark can split their join as a skewed one.
    both = pairs.select("id1", "id2").join(second, "id2").join(first, "id1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, left_at = utf8_bytes(batch.column(2))
            right, right_at = utf8_bytes(batch.column(3))
            same = np.zeros(len(batch), np.int64)
            novel, missing = [], []
            for i in range(len(batch)):
                x = left[left_at[i] : left_at[i + 1]].view(np.uint64)
                y = right[right_at[i] : right_at[i + 1]].view(np.uint64)
                hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                same[i] = hit.sum()
                if deltas:
                    novel.append(y[~hit].tobytes())
                    back = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                    missing.append(x[~back].tobytes())
            out = [batch.column(0), batch.column(1), pa.array(same)]
            out += [pa.array(np.diff(left_at) // 8), pa.array(np.diff(right_at) // 8)]
            out += [pa.array(novel, pa.binary()), pa.array(missing, pa.binary())] if deltas else []
            yield pa.record_batch(out, names)

    schema = "id1 long, id2 long, same long, n1 long, n2 long" + (", novel binary, missing binary" if deltas else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return both.select("id1", "id2", "_set1", "_set2").mapInArrow(run, schema)


def linked(percent: int) -> Column:
    return F.col("same") * 100 >= (F.col("n1") + F.col("n2") - F.col("same")) * percent


def _size_fits(n1: str, n2: str, percent: int):
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    recall: float = 0.99999,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``<id>, n_shingles, component_id, kept, n_links`` for every row of ``docs``.

    Texts are linked when ``100 * |intersection| >= percent * |union|`` of their sets of distinct
    ``size``-word shingles; ``component_id`` is the smallest id reachable, ``kept`` marks it.
    Pairs at the threshold share a table with probability ``recall``; every link is confirmed on
    full sets, so no false link is made.

    1. One pass computes set sizes, set digests and minhashes. Equal sets collapse to their
       smallest id, so copies never meet in a bucket.
    2. A text stays a candidate only while a half-key of either collection occurs twice; only
       then are its ``rows ** 2`` table keys formed.
    3. The member that shares most buckets with others leads each bucket, and each member is
       compared with the leaders of its buckets. Confirmed pairs give components.
    4. Members that stayed outside their leader's component may still be linked with other
       members of the bucket. Such pairs are found through their differences from the common leader,
       which must overlap in more than half of one of them (see ``_rest_links``); so edited copies
       of one text, each with edits of its own, do not meet each other. Pairs inside a component
       are never formed.

    ``n_links`` counts confirmed links of a set's representative, 0 for others. Null or empty
    text has an empty set and is linked with nothing. Rows that repeat an id with different
    texts are linked through that id; null ids form rows of their own with null component and
    are kept. An empty table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, size, Tensor.reaching(percent / 100, recall), percent, id_col, text_col)


def _near_duplicates(
    docs: DataFrame, size: int, tensor: Tensor, percent: int, id_col: str, text_col: str
) -> DataFrame:
    spark = docs.sparkSession
    known = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")
    )
    nameless = docs.filter(F.col(id_col).isNull()).select(
        F.lit(_NO_ID).cast("long").alias("_id"), text_of(text_col).alias("_t")
    )
    with steps(spark) as scope:
        signed = durable(signatures(known, size, tensor))
        groups = durable(
            signed.filter("n_shingles > 0")
            .groupBy("n_shingles", "_s1", "_s2")
            .agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
        )
        sizes = durable(signed.select("_id", "n_shingles", "_s1", "_s2"))
        scope.drop(signed)
        copies = settled(
            spark,
            lambda: lookup(
                sizes, groups.filter("_n > 1").select("n_shingles", "_s1", "_s2", "_rep", "_n"), ["n_shingles", "_s1", "_s2"], "_n"
            )
            .filter("_id <> _rep")
            .select(F.col("_rep").alias("src"), F.col("_id").alias("dst")),
        )
        members = settled(spark, lambda: _bucket_members(groups, tensor))
        scope.drop(groups)
        leaders = settled(spark, lambda: _leader_pairs(members))
        wanted = durable(members.select(F.col("id").alias("_id")).distinct())
        scope.drop(members)
        texts = known.filter("_t <> ''").join(within_reach(wanted), "_id", "left_semi")
        sets = durable(shingle_sets(texts, size).dropDuplicates(["_id"]))
        tied = durable(compared(leaders, sets, deltas=True))
        close = durable(tied.filter(linked(percent)).select("id1", "id2"))
        parts = connected_components(close, "id1", "id2")
        spans = settled(spark, lambda: _with_references(tied, sets))
        scope.drop(tied)
        scope.drop(sets)
        links = settled(
            spark,
            lambda: close.unionByName(_rest_links(spans, parts, percent))
            .select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
            .distinct(),
        )
        scope.drop(spans)
        edges = links.select(F.col("id1").alias("src"), F.col("id2").alias("dst")).unionByName(copies)
        final = connected_components(edges)
        degree = (
            links.select(F.col("id1").alias("_id")).unionByName(links.select(F.col("id2").alias("_id")))
            .groupBy("_id")
            .agg(F.count(F.lit(1)).alias("n_links"))
        )
        out = (
            sizes.select("_id", "n_shingles")
            .join(final.select(F.col("id").alias("_id"), "component"), "_id", "left")
            .join(degree, "_id", "left")
            .select(
                F.col("_id").alias(id_col),
                "n_shingles",
                F.coalesce("component", "_id").alias("component_id"),
                (F.coalesce("component", "_id") == F.col("_id")).alias("kept"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            )
        )
        alone = signatures(nameless, size, Tensor(1, 1)).select(
            F.lit(None).cast("long").alias(id_col),
            "n_shingles",
            F.lit(None).cast("long").alias("component_id"),
            F.lit(True).alias("kept"),
            F.lit(0).cast("long").alias("n_links"),
        )
        return scope.keep(out.unionByName(alone))


def _bucket_members(groups: DataFrame, tensor: Tensor) -> DataFrame:
    """``key, id, size`` of table keys that at least two sets hold; ``size`` is how many."""
    def shared(side: str) -> DataFrame:
        keys = groups.select(F.col("_rep").alias("id"), F.posexplode(side).alias("pos", "half"))
        often = keys.groupBy("pos", "half").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return lookup(keys, often, ["pos", "half"], "_n").groupBy("id").agg(
            F.collect_list(F.struct("pos", "half")).alias(side)
        )

    a, b = durable(shared("_a")), durable(shared("_b"))
    pairs = (
        a.join(b, "id")
        .select("id", "_b", F.explode("_a").alias("_x"))
        .select("id", "_x", F.explode("_b").alias("_y"))
        .select("id", F.xxhash64("_x.pos", "_x.half", "_y.pos", "_y.half").alias("key"))
    )
    pairs = durable(pairs)
    often = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return lookup(pairs, often.withColumn("size", F.col("_n")), ["key"], "_n").select("key", "id", "size")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's leader ``id1`` with another member ``id2``."""
    weight = members.groupBy("id").agg(F.sum("size").alias("_w"))
    leader = (
        members.join(weight, "id")
        .groupBy("key")
        .agg(F.max(F.struct("_w", (-F.col("id")).alias("_o"))).alias("_top"), F.max("size").alias("_n"))
        .select("key", (-F.col("_top._o")).alias("id1"), "_n")
    )
    met = lookup(members.select("key", F.col("id").alias("id2")), leader, ["key"], "_n")
    return met.filter("id1 <> id2").select("id1", "id2").distinct()


def _with_references(tied: DataFrame, sets: DataFrame) -> DataFrame:
    """``tied`` with each leader replaced by the text it resembles most among the leaders above it.

    A bucket that the original of many edited copies is not in has one of the copies as leader; measured from
    the original, the differences of its members are small and their own again. Any text may
    serve as reference, so this changes the work and not the result; below half similarity
    the bucket's own leader stays.
    """
    alike = F.col("same") / (F.col("n1") + F.col("n2") - F.col("same"))
    above = (
        tied.withColumn("_j", alike)
        .filter("_j >= 0.5")
        .groupBy(F.col("id2").alias("id1"))
        .agg(F.max(F.struct("_j", F.col("id1").alias("ref"))).alias("_top"))
        .select("id1", "_top.ref")
    )
    wanted = (
        tied.select("id1", "id2")
        .join(above, "id1", "left")
        .select(F.coalesce("ref", "id1").alias("id1"), "id2")
        .filter("id1 <> id2")
        .distinct()
    )
    wanted = durable(wanted)
    known = tied.join(wanted, ["id1", "id2"], "left_semi")
    fresh = durable(wanted.join(tied.select("id1", "id2"), ["id1", "id2"], "left_anti"))
    return known.unionByName(compared(fresh, sets, deltas=True))


def _lonely_elements(rows: DataFrame) -> DataFrame:
    """``lead, id, alone``: how many elements of a difference no other member of the cluster has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in (2, 3):
                data, at = utf8_bytes(batch.column(column))
                row = pa.array(np.repeat(np.arange(len(batch)), np.diff(at) // 8))
                yield pa.record_batch(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(data.view(np.int64))], ["lead", "id", "h"]
                )

    elements = rows.select("lead", "id", "novel", "missing").mapInArrow(run, "lead long, id long, h long")
    owners = elements.groupBy("lead", "h").agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("id"))
    return owners.filter("_c = 1").groupBy("lead", "id").agg(F.count(F.lit(1)).alias("alone"))


def _rest_links(tied: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links ``id1, id2`` between different components, of texts that follow one leader.

    Let dx and dy be the symmetric differences of x and y from their leader l. Theirs from each other has
    ``|dx| + |dy| - 2 |dx & dy|`` elements, and a link needs at most ``r * (nx + ny)`` with
    ``r = (100 - percent) / (100 + percent)``. One of the two, x, is outside the leader's component,
    so ``|dx| > r * (nx + nl)`` and ``|dx & dy| > v = (|dy| + r * (nl - ny)) / 2``. Hence any
    ``|dy| - floor(v)`` elements of dy, in whatever order, contain one of dx. Elements that the leader
    lacks come first: edits make them, and others seldom share them. Before that, members are left
    out whose difference shares too little with anyone in the cluster to reach these bounds. A pair that
    meets is confirmed by its two differences, which give the exact overlap of the full sets.
    """
    label = parts.select(F.col("id").alias("id2"), F.col("component").alias("part2"))
    lead = parts.select(F.col("id").alias("id1"), F.col("component").alias("part1"))
    rows = tied.join(label, "id2", "left").join(lead, "id1", "left")
    rows = rows.select(
        F.col("id1").alias("lead"),
        F.col("id2").alias("id"),
        F.coalesce("part2", "id2").alias("part"),
        (F.coalesce("part2", "id2") != F.coalesce("part1", "id1")).alias("outside"),
        F.col("n1").alias("n_lead"),
        F.col("n2").alias("n"),
        "novel",
        "missing",
    )
    rows = durable(rows)
    # A cluster needs someone outside and, besides that member and the leader, one more.
    open_leads = (
        rows.groupBy("lead")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("outside").alias("_any"))
        .filter("_any and _n > 1")
    )
    rows = lookup(rows, open_leads.drop("_any"), ["lead"], "_n")
    fraction = 2 * (100 + percent)
    rows = rows.withColumn("d", F.expr("(octet_length(novel) + octet_length(missing)) div 8"))
    rows = durable(rows.join(_lonely_elements(rows), ["lead", "id"], "left"))
    # What x or y shares with any member bounds what they share with each other.
    shared = F.col("d") - F.coalesce("alone", F.lit(0))
    v = (F.col("d") * (100 + percent) + (F.col("n_lead") - F.col("n")) * (100 - percent)) / fraction
    partner = F.floor(F.col("n") * 100 / percent) + 1
    most = F.ceil((F.col("n") + partner) * (100 - percent) / (100 + percent))
    rows = rows.withColumn("outside", F.col("outside") & (shared >= F.col("d") - most))
    rows = rows.withColumn("near", shared >= F.floor(v)).filter("near or outside")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                novel, novel_at = utf8_bytes(part.column(5))
                missing, missing_at = utf8_bytes(part.column(6))
                n_lead, n = part.column(3).to_numpy(), part.column(4).to_numpy()
                near = part.column(8).to_numpy(zero_copy_only=False)
                tokens, first = [], []
                for i in range(len(part)):
                    d = np.concatenate([novel[novel_at[i] : novel_at[i + 1]], missing[missing_at[i] : missing_at[i + 1]]])
                    d = d.view(np.int64)
                    v = (len(d) * (100 + percent) + (100 - percent) * (int(n_lead[i]) - int(n[i]))) // fraction
                    tokens.append(d)
                    first.append((np.arange(len(d)) < len(d) - v) & near[i])
                sizes = np.array([len(x) for x in tokens])
                row = np.repeat(np.arange(len(part)), sizes)
                flat, lead_in = np.concatenate(tokens), np.concatenate(first)
                picked = part.select([0, 1, 2, 4]).take(pa.array(row))
                outside = part.column(7).take(pa.array(row))
                yield pa.record_batch([*picked.columns, outside, pa.array(lead_in), pa.array(flat)], names)

    schema = "lead long, id long, part long, n long, outside boolean, early boolean, h long"
    names = [c.split()[0] for c in schema.split(", ")]
    columns = ["lead", "id", "part", "n_lead", "n", "novel", "missing", "outside", "near"]
    tokens = durable(rows.select(*columns).mapInArrow(elements, schema).filter("early or outside"))
    early = tokens.filter("early").select("lead", "h", "id", "part", "n")
    often = early.groupBy("lead", "h").agg(F.count(F.lit(1)).alias("_n"))
    outer = tokens.filter("outside").select(
        "lead", "h", F.col("id").alias("_id2"), F.col("part").alias("_part2"), F.col("n").alias("_n2")
    )
    outer = outer.join(often, ["lead", "h"])
    met = lookup(early, outer, ["lead", "h"], "_n").filter(
        (F.col("part") != F.col("_part2")) & _size_fits("n", "_n2", percent)
    )
    met = met.groupBy(F.least("id", "_id2").alias("id1"), F.greatest("id", "_id2").alias("id2")).agg(F.min("lead").alias("lead"))
    return _confirmed(met, rows, percent)


def _confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(lead, id1, id2)``; ``rows`` has the differences of both from the leader."""
    sides = [
        rows.select("lead", F.col("id").alias(f"id{i}"), F.col("n").alias(f"n{i}"), F.col("novel").alias(f"_v{i}"), F.col("missing").alias(f"_m{i}"))
        for i in (1, 2)
    ]
    both = pairs.join(sides[0], ["lead", "id1"]).join(sides[1], ["lead", "id2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [utf8_bytes(batch.column(c)) for c in range(4, 8)]
            apart = np.zeros(len(batch), np.int64)
            for i in range(len(batch)):
                v1, m1, v2, m2 = (data[at[i] : at[i + 1]].view(np.uint64) for data, at in columns)
                both = len(np.intersect1d(v1, v2, True)) + len(np.intersect1d(m1, m2, True))
                apart[i] = len(v1) + len(m1) + len(v2) + len(m2) - 2 * both
            n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            same = (n1 + n2 - apart) // 2
            hit = pa.array(same * 100 >= (n1 + n2 - same) * percent)
            yield batch.select([0, 1]).filter(hit)

    ordered = both.select("id1", "id2", "n1", "n2", "_v1", "_m1", "_v2", "_m2")
    return ordered.mapInArrow(run, "id1 long, id2 long")
