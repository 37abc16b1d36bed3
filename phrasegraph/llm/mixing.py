"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable, written_bytes
from ..plans.ordering import running_total
from ..plans.skew import BROADCAST_BYTES, lookup
from .common import text_of

#: Exponent per margin: targets are the margin's token shares to this power, renormalised.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.9}

#: Sweeps over all margins; each brings every margin in turn to its target.
SWEEPS = 20

#: Sweeps planned together before the cells are written.
PER_STEP = 5

#: Share of all tokens that a sample is expected to keep.
RETENTION = 0.5

SEED = "mix"

NAME = "unknown"


def topic_of(text_col: str = "text") -> Column:
    """A topic by surface marks (fixed values), the first that applies."""
    text = text_of(text_col)
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("License"), "legal")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


def draw(id_col: str, seed: str) -> Column:
    """A reproducible number in [0, 1) from the id as text (null as empty)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def raked(cells: DataFrame, margins: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margin columns and ``mass``) with ``factor``: the weight of a token in the cell.

    ``margins`` maps a margin column to its ``value, target`` shares. A sweep multiplies, margin after margin,
    each value's cells by target over current share. Values without a target keep their mass;
    a value whose cells are all empty is left alone.
    """
    total = cells.agg(F.sum("mass").alias("_total"))
    state = cells.withColumn("_m", F.col("mass").cast("double")).join(F.broadcast(total))
    for name, target in margins.items():
        wanted = target.select(F.col("value").alias(name), F.col("target").alias(f"_t_{name}"))
        state = state.join(wanted, name, "left")
    state = durable(state)
    for sweep in range(sweeps):
        for name in margins:
            now = F.sum("_m").over(Window.partitionBy(name))
            share = F.when((now > 0) & F.col(f"_t_{name}").isNotNull(), F.col(f"_t_{name}") * F.col("_total") / now)
            state = state.withColumn("_m", F.col("_m") * F.coalesce(share, F.lit(1.0)))
        if (sweep + 1) % PER_STEP == 0 or sweep + 1 == sweeps:
            state = durable(state)
    factor = F.when(F.col("mass") > 0, F.col("_m") / F.col("mass")).otherwise(0.0)
    return state.withColumn("factor", factor).drop("_m", "_total", *[f"_t_{m}" for m in margins])


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """``value, target``: token shares of a margin to ``power``, adding up to one."""
    mass = cells.groupBy(F.col(name).alias("value")).agg(F.sum("mass").cast("double").alias("_mass"))
    raised = mass.filter("_mass > 0").withColumn("_p", F.pow("_mass", F.lit(power)))
    total = raised.agg(F.sum("_p").alias("_all"))
    return raised.join(F.broadcast(total)).select("value", (F.col("_p") / F.col("_all")).alias("target"))


def scaled(cells: DataFrame, retention: float | None) -> DataFrame:
    """``cells`` (``mass``, ``factor``) with ``probability`` and ``missed``.

    ``probability`` is min(1, c * factor), with c solved so that the expected tokens are ``retention`` of all mass.
    A cell at 1 is saturated: it gives all it has, and the others share the rest by weight. ``missed`` is the part
    of the cell's share of the budget that it does not give; it is below zero where a cell stands in for saturated ones.
    If even all tokens of positive factor are short of the budget, all are kept. None: factor / largest factor.
    """
    if retention is None:
        top = cells.agg(F.max("factor").alias("_top"))
        share = F.when(F.col("_top") > 0, F.col("factor") / F.col("_top")).otherwise(0.0)
        return cells.join(F.broadcast(top)).withColumns({"probability": share, "missed": F.lit(0.0)}).drop("_top")
    if not 0 < retention <= 1:
        raise ValueError("retention must be above 0 and at most 1")
    level = F.sum(F.col("mass").cast("double"))
    levels = cells.filter("factor > 0").groupBy("factor").agg(level.alias("_mass")).withColumn("_want", F.expr("_mass * factor"))
    totals = durable(
        cells.agg(
            (level * F.lit(float(retention))).alias("_budget"),
            F.sum(F.when(F.col("factor") > 0, F.col("mass").cast("double"))).alias("_all"),
            F.sum(F.col("mass") * F.col("factor")).alias("_wanted"),
        )
    )
    levels = running_total(running_total(levels, ["factor"], "_mass", "_upto"), ["factor"], "_want", "_tail")
    # At c = 1 / factor all levels above this one are saturated.
    above = F.col("_all") - F.col("_upto")
    fits = levels.join(F.broadcast(totals)).filter(above + F.col("_tail") / F.col("factor") >= F.col("_budget"))
    scale = fits.agg(F.max_by((F.col("_budget") - above) / F.col("_tail"), "factor").alias("_c"))
    some = F.col("factor") > 0
    share = F.when(some, F.coalesce(F.least(F.lit(1.0), F.col("_c") * F.col("factor")), F.lit(1.0))).otherwise(0.0)
    missed = F.when(some, 1 - F.col("probability") * F.col("_wanted") / (F.col("_budget") * F.col("factor"))).otherwise(0.0)
    joined = cells.join(F.broadcast(totals)).join(F.broadcast(scale))
    return joined.withColumn("probability", share).withColumn("missed", missed).drop("_budget", "_all", "_wanted", "_c")


def mix(
    docs: DataFrame,
    temperatures: dict[str, float] | None = None,
    seed: str = SEED,
    sweeps: int = SWEEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: dict[str, DataFrame] | None = None,
    retention: float | None = RETENTION,
) -> DataFrame:
    """Every row of ``docs`` with ``mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_probability, mix_missed,
    mix_sampled``.

    Tokens are counted per cell of source, language and topic; the cells are raked until tokens times weight meet
    the target share of every source, language and topic. ``targets`` gives these shares; by default they
    are the present ones to the power ``temperatures``, which lifts small sources. A document is
    drawn with probability min(1, c * weight), where c makes the expected tokens ``retention`` of all, so a rare
    cell cannot thin the others and no document is needed twice. Cells that reach 1 cannot meet their
    target; ``mix_missed`` says by how much (see ``scaled``). With ``retention`` None the probability is
    weight / largest weight: the exact raked mix, of a size that the rarest cell sets. The draw depends on seed
    and id alone.

    Documents are counted with map-side combining and the cells are written. Up to ``BROADCAST_BYTES`` they are broadcast,
    so no text moves; beyond, they join back with hot cells spread. Null source or language counts as ``unknown``; null or empty text has no tokens and
    weight 0 unless its cell has tokens. An empty table gives no rows. Own columns named like the new
    ones are replaced.
    """
    names = ["mix_source", "mix_lang", "mix_topic"]
    new = [*names, "mix_tokens", "mix_weight", "mix_probability", "mix_missed", "mix_sampled"]
    plain = docs.drop(*new)
    keyed = plain.withColumns(
        {
            "mix_source": F.coalesce(F.col("source").cast("string"), F.lit(NAME)),
            "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NAME)),
            "mix_topic": topic_of(text_col),
            "mix_tokens": F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        }
    )
    cells = durable(
        keyed.groupBy(*names).agg(F.sum("mix_tokens").alias("mass"), F.count(F.lit(1)).alias("_n"))
    )
    powers = TEMPERATURES if temperatures is None else temperatures
    margins = {
        f"mix_{m}": (targets or {}).get(m) if targets and m in targets else durable(tempered(cells, f"mix_{m}", powers[m]))
        for m in ("source", "lang", "topic")
    }
    weighted = scaled(raked(cells, margins, sweeps), retention).select(
        *names,
        "_n",
        F.col("factor").alias("mix_weight"),
        F.col("probability").alias("mix_probability"),
        F.col("missed").alias("mix_missed"),
    )
    weighted = durable(weighted)
    if written_bytes(weighted) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(weighted.drop("_n")), names)
    else:
        joined = lookup(keyed, weighted, names, "_n")
    return joined.withColumn("mix_sampled", draw(id_col, seed) < F.col("mix_probability")).select(*plain.columns, *new)
