"""Global numbering, prefix sums, ranks and quantiles without a one-task window.

All of them range-partition the rows, number them inside each partition and add the
totals of the partitions before it. The table of partition totals has one row per
partition, which is why it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

_SLOT_BITS = 33


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sort globally and fix each row's (partition, position) in a durable copy."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return durable(placed).withColumn("_part", F.shiftright("_slot", _SLOT_BITS))


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 1) -> DataFrame:
    """Number the rows ``start, start+1, …`` in the given (unique) global order."""
    placed = _ranged(df, order)
    position = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, position + F.col("_offset") + F.lit(start))
        .drop("_slot", "_part", "_offset")
    )


def running_total(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str, inclusive: bool = True
) -> DataFrame:
    """Sum of ``value`` over all rows up to this one (or before it) in the global order."""
    placed = _ranged(df, order)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_part").orderBy("_slot")
    here = F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_offset")
    if not inclusive:
        here = here - F.col(value)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, here)
        .drop("_slot", "_part", "_offset")
    )


def _value_counts(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).alias(column))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def average_ranks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value (per group): ``column`` and its mean rank ``rank``."""
    by = list(by)
    counted = running_total(
        _value_counts(df, column, by), [*by, column], "_n", "_before", inclusive=False
    )
    if by:
        starts = counted.groupBy(*by).agg(F.min("_before").alias("_start"))
        counted = counted.join(starts, by)
    else:
        counted = counted.withColumn("_start", F.lit(0))
    rank = F.col("_before") - F.col("_start") + (F.col("_n") + 1) / F.lit(2.0)
    return counted.select(*by, column, rank.alias("rank"), F.col("_n").alias("n"))


def with_average_rank(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Attach the tie-averaged rank of ``column``; ties are ranked once, then joined back."""
    from .skew import lookup

    ranks = average_ranks(df, column, by).withColumnRenamed("rank", name)
    return lookup(df, ranks, [*by, column], "n")


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated (type 7) quantiles ``prob, value`` of a column of any size."""
    counted = running_total(_value_counts(df, column, []), [column], "_n", "_upto")
    total = counted.agg(F.sum("_n").alias("_total"))
    wanted = (
        total.filter("_total > 0")
        .select("_total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("_h", (F.col("_total") - 1) * F.col("prob"))
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
    )
    covers_lo = (F.col("_lo") >= F.col("_upto") - F.col("_n")) & (F.col("_lo") < F.col("_upto"))
    covers_hi = (F.col("_hi") >= F.col("_upto") - F.col("_n")) & (F.col("_hi") < F.col("_upto"))
    return (
        counted.join(F.broadcast(wanted), covers_lo | covers_hi)
        .groupBy("prob")
        .agg(
            F.max(F.when(covers_lo, F.col(column))).alias("_vlo"),
            F.max(F.when(covers_hi, F.col(column))).alias("_vhi"),
            F.max(F.col("_h") - F.col("_lo")).alias("_frac"),
        )
        .select("prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("value"))
    )


def share_of_total(df: DataFrame, column: str, name: str) -> DataFrame:
    """Each row's share of the column total; null when the total is zero."""
    total = df.agg(F.sum(column).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col(column) / F.col("_total"))
    return df.join(F.broadcast(total)).withColumn(name, share).drop("_total")
