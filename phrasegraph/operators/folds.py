"""Leakage-free k-fold split of a labelled pair graph: no phrase ends up in two folds.

Components (or communities inside large ones) are blocks; whole blocks are packed into
folds of similar weight; pairs whose ends fall into different folds are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, steps
from ..plans.ordering import dense_index, exact_quantiles, running_total, share_of_total
from ..plans.skew import lookup
from .checks import require_columns, require_rows
from .communities import communities
from .evaluation import right_closed_bin
from .graph import component_sizes, connected_components

#: The split's default parameters.
K_FOLDS = 5
SCORE_BINS = 10
GIANT_NODES = 50
GIANT_EDGES = 100


def canonical_edges(pairs: DataFrame) -> DataFrame:
    """Ends ordered and non-empty, no self-loops, distinct over the ends and all other columns."""
    require_columns(pairs, ["kw1", "kw2"], "labelled pairs")
    a, b = F.col("kw1").cast("string"), F.col("kw2").cast("string")
    rest = [c for c in pairs.columns if c not in ("kw1", "kw2")]
    valid = pairs.filter(a.isNotNull() & b.isNotNull() & (F.length(a) > 0) & (F.length(b) > 0) & (a != b))
    return valid.select(F.least(a, b).alias("kw1"), F.greatest(a, b).alias("kw2"), *rest).dropDuplicates()


def large_components(sizes: DataFrame, min_nodes: int = GIANT_NODES, min_edges: int = GIANT_EDGES) -> DataFrame:
    return sizes.filter((F.col("n_nodes") >= min_nodes) | (F.col("n_edges") >= min_edges))


def assign_blocks(
    edges: DataFrame, min_nodes: int = GIANT_NODES, min_edges: int = GIANT_EDGES
) -> tuple[DataFrame, DataFrame]:
    """``keyword, block_id`` and ``block_id, orig_comp_id, block_type, n_nodes``.

    A small component is one block, a large one is cut into communities. Blocks are numbered
    in the order of their smallest keyword, components likewise.
    """
    edges = durable(edges.select("kw1", "kw2"))
    comps = durable(connected_components(edges, "kw1", "kw2"))
    sizes = component_sizes(comps, edges, "kw1")
    numbered = durable(dense_index(sizes, ["component"], "orig_comp_id"))
    large = large_components(numbered, min_nodes, min_edges).select("component", "n_nodes")
    in_large = durable(lookup(comps, large, ["component"], "n_nodes"))
    small = numbered.join(large.select("component"), "component", "left_anti")
    keys = lookup(comps, small.select("component", "n_nodes"), ["component"], "n_nodes").select(
        "id", F.col("component").alias("_key"), "component", F.lit("component").alias("block_type")
    )
    if not in_large.isEmpty():
        degree = edges.groupBy("kw1").agg(F.count(F.lit(1)).alias("_n"))
        inside = in_large.select(F.col("id").alias("kw1")).join(degree, "kw1")
        found = communities(lookup(edges, inside, ["kw1"], "_n"), in_large, "kw1", "kw2")
        keys = keys.unionByName(
            found.join(in_large, "id").select(
                "id", F.col("community").alias("_key"), "component", F.lit("community").alias("block_type")
            )
        )
    keys = durable(keys)
    blocks = keys.groupBy("_key", "component", "block_type").agg(F.count(F.lit(1)).alias("n_nodes"))
    per_comp = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    comp_ids = numbered.select("component", "orig_comp_id").join(per_comp, "component")
    blocks = durable(dense_index(lookup(blocks, comp_ids, ["component"], "_n"), ["_key"], "block_id"))
    named = blocks.select("_key", "block_id", F.col("n_nodes").alias("_n"))
    nodes = lookup(keys, named, ["_key"], "_n").select(F.col("id").alias("keyword"), "block_id")
    return nodes, blocks.select("block_id", "orig_comp_id", "block_type", "n_nodes")


def tag_edges(edges: DataFrame, nodes: DataFrame, column: str = "block_id", name: str = "block") -> DataFrame:
    """Edges with the value of both ends as ``<name>1, <name>2``; busy keywords stay balanced."""
    for side in ("1", "2"):
        end = f"kw{side}"
        uses = edges.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        ends = nodes.select(F.col("keyword").alias(end), F.col(column).alias(f"{name}{side}")).join(uses, end)
        edges = lookup(edges, ends, [end], "_n")
    return edges


def intra_edges(tagged: DataFrame) -> DataFrame:
    return tagged.filter("block1 = block2").withColumn("block_id", F.col("block1")).drop("block1", "block2")


def cross_pairs(tagged: DataFrame) -> DataFrame:
    """``b1 < b2, w``: edges between two blocks."""
    return (
        tagged.filter("block1 <> block2")
        .groupBy(F.least("block1", "block2").alias("b1"), F.greatest("block1", "block2").alias("b2"))
        .agg(F.count(F.lit(1)).alias("w"))
    )


def neighbours(cross: DataFrame) -> DataFrame:
    """``block_id, nb, w`` in both directions."""
    return cross.select(F.col("b1").alias("block_id"), F.col("b2").alias("nb"), "w").unionByName(
        cross.select(F.col("b2").alias("block_id"), F.col("b1").alias("nb"), "w")
    )


def block_stats(blocks: DataFrame, tagged: DataFrame, balance_by: str = "edges") -> DataFrame:
    """Blocks with edge counts, ``weight``, ``cross_degree`` and ``strength``.

    The weight is edges or nodes; if all weights are zero it falls back to nodes.
    """
    if balance_by not in ("edges", "nodes"):
        raise ValueError("balance_by must be 'edges' or 'nodes'")
    inside = intra_edges(tagged).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_edges_intra"))
    touching = neighbours(cross_pairs(tagged)).groupBy("block_id").agg(F.sum("w").alias("n_edges_cut_touching"))
    counted = blocks.join(inside, "block_id", "left").join(touching, "block_id", "left")
    counted = counted.fillna(0, ["n_edges_intra", "n_edges_cut_touching"])
    wanted = F.col("n_edges_intra") if balance_by == "edges" else F.col("n_nodes")
    counted = counted.withColumn("_wanted", wanted)
    top = counted.agg(F.max("_wanted").alias("_top"))  # one row
    return (
        counted.join(F.broadcast(top))
        .withColumn("weight", F.when(F.col("_top") > 0, F.col("_wanted")).otherwise(F.col("n_nodes")))
        .withColumn("cross_degree", F.col("n_edges_cut_touching"))
        .withColumn("strength", F.col("n_edges_intra") + F.col("cross_degree"))
        .drop("_wanted", "_top")
    )


def score_breaks(edges: DataFrame, score_col: str, n_bins: int = SCORE_BINS) -> list[float]:
    """Distinct exact quantiles at ``n_bins + 1`` even points; [] if fewer than two differ."""
    require_columns(edges, [score_col], "score column")
    if edges.schema[score_col].dataType.typeName() not in ("double", "float", "integer", "long", "short", "decimal"):
        raise ValueError(f"score column {score_col} must be numeric")
    value = F.col(score_col).cast("double")
    finite = edges.select(value.alias("_s")).filter(~F.isnan("_s") & (F.abs("_s") != float("inf")))
    probs = [i / n_bins for i in range(n_bins + 1)]
    found = sorted({r["value"] for r in exact_quantiles(finite, "_s", probs).collect()})
    return found if len(found) >= 2 else []


def score_histogram(intra: DataFrame, blocks: DataFrame, score_col: str, breaks: Sequence[float]) -> DataFrame:
    """``block_id, bin_1 .. bin_B``: intra-block edges per score bin, missing bins 0."""
    binned = intra.select("block_id", right_closed_bin(F.col(score_col), breaks, True).alias("_bin"))
    wide = binned.groupBy("block_id").agg(
        *[F.count_if(F.col("_bin") == b).alias(f"bin_{b}") for b in range(1, len(breaks))]
    )
    return blocks.select("block_id").join(wide, "block_id", "left").fillna(0)


# -- packing --------------------------------------------------------------------------------


def fill_shares(weights: Sequence[float], total: float) -> list[float]:
    """How much each fold takes so that the lightest are raised to one common level."""
    order = sorted(range(len(weights)), key=lambda f: (weights[f], f))
    level, left = weights[order[0]], total
    for count, fold in enumerate(order, start=1):
        nxt = weights[order[count]] if count < len(order) else math.inf
        step = (nxt - level) * count
        if step >= left:
            level += left / count
            break
        level, left = nxt, left - step
    return [max(0.0, level - w) for w in weights]


def _fold_at(middle: Column, shares: Sequence[float]) -> Column:
    """The fold whose interval on the running weight holds the middle of a block."""
    bounds, upto = [], 0.0
    for share in shares:
        upto += share
        bounds.append(upto)
    widest = max(range(len(shares)), key=lambda f: shares[f])
    out = F.lit(widest + 1)
    for fold in range(len(shares) - 1, -1, -1):
        if shares[fold] > 0:
            out = F.when(middle <= bounds[fold], fold + 1).otherwise(out)
    return out


def pack_blocks(stats: DataFrame, cross: DataFrame, k: int = K_FOLDS) -> DataFrame:
    """``block_id, fold`` with folds balanced by kept edges.

    Blocks are ranked by strength, the first k seed one fold each, and the rest is dealt in
    rounds of doubling size. A round's blocks are laid end to end by weight and each falls
    into the fold whose missing weight covers its middle. Cross edges a fold has
    captured count before the next round. Only k numbers per round reach the driver.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = dense_index(
        stats.select("block_id", "strength", "n_nodes", F.col("weight").cast("double").alias("weight")),
        [F.desc("strength"), F.desc("n_nodes"), F.col("block_id")],
        "_rank",
    )
    slot = (F.col("_rank") - 1) / F.lit(float(k))
    turn = F.when(F.col("_rank") <= k, 0).otherwise(F.floor(F.log2(slot)) + 1).cast("int")
    laid = durable(running_total(durable(ranked).withColumn("_turn", turn), ["_rank"], "weight", "_upto"))
    turns = {
        r["_turn"]: (r["_w"], r["_start"])
        for r in laid.groupBy("_turn")
        .agg(F.sum("weight").alias("_w"), F.min(F.col("_upto") - F.col("weight")).alias("_start"))
        .collect()
    }
    cross = durable(cross)
    has_cross = not cross.isEmpty()
    fold = F.when(F.col("_turn") == 0, F.col("_rank").cast("int"))
    own = {r["_rank"]: r["weight"] for r in laid.filter("_turn = 0").select("_rank", "weight").collect()}
    weights = [float(own.get(f + 1, 0.0)) for f in range(k)]
    for number in sorted(t for t in turns if t > 0):
        if has_cross:
            placed = laid.filter(F.col("_turn") < number).select("block_id", fold.alias("fold"), "weight")
            weights = _fold_weights(placed, cross, k)
        total, start = turns[number]
        if total > 0:
            shares = fill_shares(weights, total)
            middle = F.col("_upto") - F.col("weight") / 2 - F.lit(start)
            here = F.when(F.col("weight") > 0, _fold_at(middle, shares)).otherwise(
                (F.pmod(F.col("_rank") - 1, F.lit(k)) + 1).cast("int")
            )
        else:
            here = (F.pmod(F.col("_rank") - 1, F.lit(k)) + 1).cast("int")
        fold = F.when(F.col("_turn") == number, here).otherwise(fold)
        if not has_cross:
            added = laid.filter(F.col("_turn") == number).groupBy(here.alias("f")).agg(F.sum("weight").alias("w"))
            for row in added.collect():
                weights[row["f"] - 1] += row["w"]
    return laid.select("block_id", fold.cast("int").alias("fold"))


def _captured(folds: DataFrame, cross: DataFrame) -> DataFrame:
    """Cross pairs whose two blocks share a fold: ``fold, w``."""
    uses1 = cross.groupBy("b1").agg(F.count(F.lit(1)).alias("_n"))
    uses2 = cross.groupBy("b2").agg(F.count(F.lit(1)).alias("_n"))
    one = folds.select(F.col("block_id").alias("b1"), F.col("fold").alias("_f1")).join(uses1, "b1")
    two = folds.select(F.col("block_id").alias("b2"), F.col("fold").alias("_f2")).join(uses2, "b2")
    both = lookup(lookup(cross, one, ["b1"], "_n"), two, ["b2"], "_n")
    return both.filter("_f1 = _f2").select(F.col("_f1").alias("fold"), "w")


def _fold_weights(placed: DataFrame, cross: DataFrame, k: int) -> list[float]:
    own = placed.groupBy("fold").agg(F.sum("weight").alias("w"))
    won = _captured(placed, cross).groupBy("fold").agg(F.sum("w").cast("double").alias("w"))
    found = {r["fold"]: r["w"] for r in own.unionByName(won).groupBy("fold").agg(F.sum("w").alias("w")).collect()}
    return [float(found.get(f + 1, 0.0)) for f in range(k)]


# -- exchanging blocks between folds --------------------------------------------------------


def bin_columns(histogram: DataFrame) -> list[str]:
    return [c for c in histogram.columns if c.startswith("bin_")]


def fold_bins(folds: DataFrame, histogram: DataFrame, k: int) -> list[list[int]]:
    """Edges per fold and score bin: ``k`` lists, small whatever the data."""
    bins = bin_columns(histogram)
    if not bins:
        return [[] for _ in range(k)]
    sums = folds.join(histogram, "block_id").groupBy("fold").agg(*[F.sum(c).alias(c) for c in bins])
    found = {r["fold"]: [int(r[c]) for c in bins] for r in sums.collect()}
    return [found.get(f + 1, [0] * len(bins)) for f in range(k)]


def histogram_distance(bins: Sequence[Sequence[int]]) -> float:
    """Sum over folds and bins of the distance from an even share, relative to that share."""
    k = len(bins)
    even = [sum(row[b] for row in bins) / k for b in range(len(bins[0]))]
    return sum(abs(row[b] - even[b]) / max(even[b], 1.0) for row in bins for b in range(len(even)))


def fold_pairings(k: int) -> list[list[tuple[int, int]]]:
    """Every two folds once, in rounds of pairs that share no fold."""
    seats: list[int | None] = [*range(1, k + 1), *([None] if k % 2 else [])]
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        across = zip(seats[:half], reversed(seats[half:]), strict=True)
        out.append([(min(a, b), max(a, b)) for a, b in across if a is not None and b is not None])
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def _pull(placed: DataFrame, cross: DataFrame) -> DataFrame:
    """``block_id, _pull``: cross edges of a block to the partner fold less those to its own."""
    links = neighbours(cross)
    for key, cols in (("block_id", ("_f", "_pair")), ("nb", ("_g", "_pair2"))):
        uses = links.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        ends = placed.select(
            F.col("block_id").alias(key), F.col("fold").alias(cols[0]), F.col("_pair").alias(cols[1])
        ).join(uses, key)
        links = lookup(links, ends, [key], "_n")
    signed = F.when(F.col("_f") == F.col("_g"), -F.col("w")).otherwise(F.col("w"))
    return links.filter("_pair = _pair2").groupBy("block_id").agg(F.sum(signed).cast("double").alias("_pull"))


def _offers(placed: DataFrame, urge: Column) -> DataFrame:
    """Exchanges ``_pair, _one, _two, _level``: blocks of equal weight, matched by rank.

    In each pair of folds and weight the blocks of the first fold, keenest to leave first, meet those of the second.
    Exchanges are ordered by their promised gain; level n holds the places from 2^n to 2^(n+1) - 1.
    """
    keen = placed.withColumn("_urge", F.when(F.col("_second"), -urge).otherwise(urge))
    by = ["_pair", "weight", "_second"]
    ranked = durable(dense_index(keen, [*by, F.desc("_urge"), F.col("block_id")], "_at"))
    firsts = ranked.groupBy(*by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranked = lookup(ranked, firsts, by, "_n").withColumn("_rank", F.col("_at") - F.col("_first"))
    one = ranked.filter(~F.col("_second")).select(
        "_pair", "weight", "_rank", F.col("block_id").alias("_one"), F.col("_urge").alias("_u1")
    )
    two = ranked.filter("_second").select(
        "_pair", "weight", "_rank", F.col("block_id").alias("_two"), F.col("_urge").alias("_u2")
    )
    gain = F.col("_u1") + F.col("_u2")
    matched = one.join(two, ["_pair", "weight", "_rank"]).withColumn("_gain", gain).filter("_gain > 0")
    ordered = durable(dense_index(matched, [F.col("_pair"), F.desc("_gain"), F.col("_one")], "_at"))
    starts = ordered.groupBy("_pair").agg(F.min("_at").alias("_first"))  # one row per pair of folds
    place = F.col("_at") - F.col("_first") + 1
    return ordered.join(F.broadcast(starts), "_pair").select(
        "_pair", "_one", "_two", F.floor(F.log2(place.cast("double"))).cast("int").alias("_level")
    )


def _moves(offers: DataFrame) -> DataFrame:
    return offers.select(F.col("_one").alias("block_id"), "_level").unionByName(
        offers.select(F.col("_two").alias("block_id"), "_level")
    )


def _try_exchanges(
    folds: DataFrame, stats: DataFrame, histogram: DataFrame, cross: DataFrame | None,
    pairing: Sequence[tuple[int, int]], bins: list[list[int]], by_score: bool,
) -> tuple[DataFrame, list[list[int]], int]:
    """One round over disjoint pairs of folds: the new folds, their bins and the cross edges won.

    Both measures are known exactly after each level of exchanges, from sums per level. Each
    pair of folds takes the levels up to the best place at which neither is worse; none if nothing improves.
    """
    columns = bin_columns(histogram)
    k, width = len(bins), len(columns)
    partner = {f: (i, second) for i, pair in enumerate(pairing) for second, f in enumerate(pair)}
    index = F.create_map(*[F.lit(x) for f, (i, _) in partner.items() for x in (f, i)])
    side = F.create_map(*[F.lit(x) for f, (_, s) in partner.items() for x in (f, bool(s))])
    placed = (
        folds.join(stats.select("block_id", "weight"), "block_id")
        .join(histogram, "block_id")
        .withColumn("_pair", index[F.col("fold")])
        .withColumn("_second", side[F.col("fold")])
        .filter(F.col("_pair").isNotNull())
    )
    placed = durable(placed)
    if by_score:
        even = [sum(row[b] for row in bins) / k for b in range(width)]

        def slope(f: int, b: int) -> float:
            over = bins[f - 1][b] - even[b]
            return ((over > 0) - (over < 0)) / max(even[b], 1.0)

        urge = F.lit(0.0)
        for number, (f, g) in enumerate(pairing):
            toward = F.lit(0.0)
            for b, column in enumerate(columns):
                toward = toward + F.lit(float(slope(f, b) - slope(g, b))) * F.col(column)
            urge = F.when(F.col("_pair") == number, toward).otherwise(urge)
        offers = durable(_offers(placed, urge))
    else:
        pulled = placed.join(_pull(placed, cross), "block_id", "left").fillna(0.0, ["_pull"])
        # The second fold's blocks are as keen to leave by their own pull.
        offers = durable(_offers(pulled, F.when(F.col("_second"), -F.col("_pull")).otherwise(F.col("_pull"))))
    moves = durable(_moves(offers))
    state = durable(placed.join(moves, "block_id", "left"))

    shift: dict[int, dict[int, list[int]]] = {}
    sign = F.when(F.col("_second"), 1).otherwise(-1)
    sums = state.filter(F.col("_level").isNotNull()).groupBy("_pair", "_level").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c) * sign).alias(c) for c in columns]
    )
    for r in sums.collect():
        shift.setdefault(r["_pair"], {})[r["_level"]] = [int(r[c]) for c in columns]
    if not shift:
        return folds, bins, 0
    links = _link_levels(state, cross) if cross is not None else []

    chosen: dict[int, int] = {}
    new_bins, won = [list(row) for row in bins], 0
    for number, (f, g) in enumerate(pairing):
        start = [list(row) for row in new_bins]
        best, best_key, best_bins, best_won = None, (histogram_distance(start) if width else 0.0, 0), start, 0
        base = best_key[0]
        rows = [list(row) for row in start]
        for level in sorted(shift.get(number, {})):
            for b, change in enumerate(shift[number][level]):
                rows[f - 1][b] += change
                rows[g - 1][b] -= change
            distance = histogram_distance(rows) if width else 0.0
            gained = sum(w * (_together(x, level) - _together(x, -1)) for p, *x, w in links if p == number)
            if gained >= 0 and distance <= base and (distance, -gained) < best_key:
                best, best_key = level, (distance, -gained)
                best_bins, best_won = [list(row) for row in rows], gained
        if best is not None:
            chosen[number] = best
            new_bins, won = best_bins, won + best_won
    if not chosen:
        return folds, bins, 0
    taken = F.create_map(*[F.lit(x) for item in chosen.items() for x in item])
    other = F.create_map(*[F.lit(x) for f, g in pairing for x in (f, g, g, f)])
    gone = state.filter(F.col("_level") <= taken[F.col("_pair")]).select(
        "block_id", other[F.col("fold")].cast("int").alias("_to")
    )
    moved = folds.join(gone, "block_id", "left").select("block_id", F.coalesce("_to", "fold").alias("fold"))
    return moved, new_bins, won


def _link_levels(state: DataFrame, cross: DataFrame) -> list[tuple]:
    """Cross edges inside each pair of folds, summed by the sides and levels of both ends.

    A pair of folds has at most (2 * 63)^2 such sums, so the list is small whatever the data.
    """
    never = F.coalesce(F.col("_level"), F.lit(-1))
    links = cross
    for end, tag in (("b1", "1"), ("b2", "2")):
        uses = links.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        ends = state.select(
            F.col("block_id").alias(end), F.col("_pair").alias(f"_p{tag}"),
            F.col("_second").alias(f"_s{tag}"), never.alias(f"_l{tag}"),
        ).join(uses, end)
        links = lookup(links, ends, [end], "_n")
    sums = links.filter("_p1 = _p2").groupBy("_p1", "_s1", "_l1", "_s2", "_l2").agg(F.sum("w").alias("w"))
    return [(r["_p1"], r["_s1"], r["_l1"], r["_s2"], r["_l2"], int(r["w"])) for r in sums.collect()]


def _together(link: Sequence, level: int) -> bool:
    """Whether both ends share a fold once the exchanges up to ``level`` are made."""
    side1, level1, side2, level2 = link
    return (side1 ^ (0 <= level1 <= level)) == (side2 ^ (0 <= level2 <= level))


def exchange_blocks(
    folds: DataFrame,
    stats: DataFrame,
    histogram: DataFrame | None,
    cross: DataFrame,
    k: int = K_FOLDS,
    tolerance: float = 0.02,
) -> DataFrame:
    """``block_id, fold`` after exchanging blocks of equal weight between folds.

    ``histogram`` is ``block_id, bin_1 ..`` (None: no score). Exchanges leave the weight of every fold as it is.
    They are made in bulk, two folds at a time, and only as far as neither the distance of the folds' score
    histograms from even ones grows nor captured cross edges are lost, and one of both improves. Sweeps
    over all pairs of folds go on while one lowers the distance by ``tolerance`` of it or wins ``tolerance`` of
    the cross edges. Without score and cross edges the folds come back unchanged.
    """
    blank = histogram if histogram is not None else stats.select("block_id")
    with_score, with_cross = bool(bin_columns(blank)), not cross.isEmpty()
    if not with_score and not with_cross:
        return folds
    spark = folds.sparkSession
    with steps(spark) as outer:
        blank, stats, cross = durable(blank), durable(stats), durable(cross)
        links = cross if with_cross else None
        n_cross = int(cross.agg(F.sum("w")).first()[0] or 0)
        current = durable(folds)
        bins = fold_bins(current, blank, k)
        going = True
        while going:
            before, won = (histogram_distance(bins) if with_score else 0.0), 0
            for pairing in fold_pairings(k):
                for by_score in (True, False):
                    if not (with_score if by_score else with_cross):
                        continue
                    with steps(spark) as scope:
                        moved, bins, gain = _try_exchanges(current, stats, blank, links, pairing, bins, by_score)
                        kept = current if moved is current else scope.keep(moved)
                    if kept is not current:
                        outer.drop(current)
                    current, won = kept, won + gain
            after = histogram_distance(bins) if with_score else 0.0
            going = before - after > tolerance * before or won > tolerance * n_cross
        return outer.keep(current)


def fold_weights(folds: DataFrame, stats: DataFrame, cross: DataFrame) -> DataFrame:
    """``fold, weight``: block weights plus captured cross edges."""
    own = folds.join(stats.select("block_id", "weight"), "block_id").select("fold", F.col("weight").alias("w"))
    both = own.unionByName(_captured(folds, cross))
    return both.groupBy("fold").agg(F.sum("w").cast("long").alias("weight"))


# -- results --------------------------------------------------------------------------------


def keyword_folds(nodes: DataFrame, folds: DataFrame) -> DataFrame:
    """``keyword, fold``; an error if a keyword would get two folds."""
    sizes = nodes.groupBy("block_id").agg(F.count(F.lit(1)).alias("_n"))
    out = lookup(nodes, folds.join(sizes, "block_id"), ["block_id"], "_n").select("keyword", "fold")
    twice = out.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("a keyword was assigned to more than one fold")
    return out


def with_folds(edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """Edges with ``fold1, fold2``."""
    return tag_edges(edges, keywords, "fold", "fold")


def kept_pairs(tagged: DataFrame) -> DataFrame:
    return tagged.filter("fold1 = fold2").withColumn("fold", F.col("fold1")).drop("fold1", "fold2")


def cut_summary(tagged: DataFrame) -> DataFrame:
    """``n_edges, n_cut, cut_ratio``."""
    cut = F.count_if(F.col("fold1") != F.col("fold2"))
    n = F.count(F.lit(1))
    return tagged.agg(n.alias("n_edges"), cut.alias("n_cut"), F.when(n > 0, cut / n).alias("cut_ratio"))


def symmetrize(pairs: DataFrame) -> DataFrame:
    """Add the flipped copy of every pair, other columns unchanged."""
    flipped = pairs.select(
        F.col("kw2").alias("kw1"), F.col("kw1").alias("kw2"), *[c for c in pairs.columns if c not in ("kw1", "kw2")]
    )
    return pairs.unionByName(flipped)


def block_table(stats: DataFrame, folds: DataFrame) -> DataFrame:
    """The block table, heaviest first."""
    return (
        stats.join(folds, "block_id")
        .select(
            F.col("block_id").alias("comp_id"),
            "orig_comp_id",
            "block_type",
            "n_nodes",
            F.col("n_edges_intra").alias("n_edges"),
            "n_edges_cut_touching",
            "weight",
            "fold",
        )
        .orderBy(F.desc("weight"), "comp_id")
    )


def fold_summary(kept: DataFrame, weights: DataFrame, k: int = K_FOLDS) -> DataFrame:
    """``fold, n_edges, weight`` and shares; a fold without edges is present with 0."""
    all_folds = kept.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("fold"))
    counts = kept.groupBy("fold").agg(F.count(F.lit(1)).alias("n_edges"))
    out = all_folds.join(counts, "fold", "left").join(weights, "fold", "left").fillna(0, ["n_edges", "weight"])
    out = durable(out)
    return share_of_total(share_of_total(out, "n_edges", "edges_share"), "weight", "weight_share")


def split(
    pairs: DataFrame,
    k: int = K_FOLDS,
    balance_by: str = "edges",
    min_nodes: int = GIANT_NODES,
    min_edges: int = GIANT_EDGES,
    symmetric: bool = True,
    score_col: str | None = None,
    n_score_bins: int = SCORE_BINS,
    exchange: bool = False,
) -> dict[str, DataFrame]:
    """The whole split: tables ``pairs``, ``blocks``, ``keywords`` and ``summary``.

    With ``score_col`` the folds' score histograms are brought close to one another by exchanging blocks;
    ``exchange`` does so for captured cross edges alone.
    """
    edges = require_rows(durable(canonical_edges(pairs)), "labelled pairs")
    nodes, blocks = assign_blocks(edges, min_nodes, min_edges)
    nodes = durable(nodes)
    tagged = durable(tag_edges(edges, nodes))
    stats = durable(block_stats(blocks, tagged, balance_by))
    cross = durable(cross_pairs(tagged))
    histogram = None
    if score_col is not None:
        breaks = score_breaks(edges, score_col, n_score_bins)
        if breaks:
            histogram = score_histogram(intra_edges(tagged), blocks, score_col, breaks)
    folds = durable(pack_blocks(stats, cross, k))
    if exchange or histogram is not None:
        folds = exchange_blocks(folds, stats, histogram, cross, k)
    keywords = durable(keyword_folds(nodes, folds))
    kept = durable(kept_pairs(with_folds(edges, keywords)))
    return {
        "pairs": symmetrize(kept) if symmetric else kept,
        "blocks": block_table(stats, folds),
        "keywords": keywords.orderBy("keyword"),
        "summary": fold_summary(kept, fold_weights(folds, stats, cross), k),
    }
