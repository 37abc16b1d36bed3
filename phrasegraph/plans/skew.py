"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, written_bytes

#: Written size up to which a step goes to every task. In memory it takes a few times that.
BROADCAST_BYTES = 8 << 20

#: A dimension counted to have at most this many rows joins plainly; Spark picks the strategy.
SMALL_ROWS = 200_000

#: A key is heavy when it holds more than 1/HEAVY_SHARE of the rows, so there are fewer
#: heavy keys than this, whatever the size of the data.
HEAVY_SHARE = 1_000


def within_reach(step: DataFrame) -> DataFrame:
    """A written step, marked for broadcast if its files are small; beyond that Spark chooses the join.

    Spark judges a join by estimates that grow with every operator in between; the files tell the size.
    """
    size = written_bytes(step)
    return F.broadcast(step) if size is not None and size <= BROADCAST_BYTES else step


def lookup(
    big: DataFrame,
    dim: DataFrame,
    keys: list[str],
    weight: str,
    dim_rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join of ``big`` with ``dim``; ``weight`` in ``dim`` is the key's row count in ``big``.

    ``dim`` is written once, so both sides are read once and Spark broadcasts it only by its
    real size. Rows of a heavy key are spread over salts in proportion to its weight and the
    few ``dim`` rows of that key are repeated once per salt. Only heavy keys (fewer than
    ``HEAVY_SHARE``, no payload) are broadcast. ``how`` is ``inner`` or ``left``; null keys
    match nothing. ``weight`` is dropped. A dimension that the caller has counted (``dim_rows``)
    and found small is left to Spark's own choice of join.
    """
    if dim_rows is not None and dim_rows <= SMALL_ROWS:
        return big.join(dim.drop(weight), keys, how)
    dim = durable(dim)
    per_key = dim.groupBy(*keys).agg(F.max(weight).alias("_w"))
    total = per_key.agg(F.sum("_w").alias("_total"))
    heavy = (
        per_key.join(F.broadcast(total))
        .filter(F.col("_w") * HEAVY_SHARE > F.col("_total"))
        .select(*keys, F.ceil(F.col("_w") * HEAVY_SHARE / F.col("_total")).cast("int").alias("_salts"))
    )
    heavy = F.broadcast(heavy)
    # The salt is a function of the row, so a task that runs again deals its rows alike.
    spread = [c for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
    salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*spread), F.col("_salts"))).otherwise(0)
    salted = big.join(heavy, keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = dim.drop(weight).join(heavy, keys, "left").withColumn("_salt", copies).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def grouped_pairs(
    members: DataFrame,
    key: str,
    member: str,
    payload: list[str],
    keep: Column | None = None,
    block_rows: int = 512,
) -> DataFrame:
    """Pairs ``id1 < id2`` of members that share ``key``, with no oversized join key.

    Groups above ``block_rows`` are cut into hash blocks and joined block against block, so
    no join key carries more than about ``block_rows`` rows per side. ``keep`` is a
    condition over ``<payload>1`` and ``<payload>2`` applied inside the join.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = sizes.select(
        key, "_n", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_blocks")
    )
    sized = lookup(members, sizes, [key], "_n").withColumn(
        "_block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")
    )
    last = F.col("_blocks") - 1
    left = sized.select(
        F.col(key).alias("_key"),
        F.col("_block").alias("_a"),
        F.explode(F.sequence(F.lit(0), last)).alias("_b"),
        F.col(member).alias("id1"),
        *[F.col(c).alias(f"{c}1") for c in payload],
    )
    right = sized.select(
        F.col(key).alias("_key"),
        F.explode(F.sequence(F.lit(0), last)).alias("_a"),
        F.col("_block").alias("_b"),
        F.col(member).alias("id2"),
        *[F.col(c).alias(f"{c}2") for c in payload],
    )
    joined = left.join(right, ["_key", "_a", "_b"]).filter("id1 < id2")
    if keep is not None:
        joined = joined.filter(keep)
    return joined.drop("_a", "_b").withColumnRenamed("_key", key)
