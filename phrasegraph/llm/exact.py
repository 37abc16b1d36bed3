"""Exact duplicates by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..plans.skew import lookup
from .common import SPACE, text_of

#: Code points of the normalised text that the second key reads.
PREFIX = 256


def normalised(column: str = "text") -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(text_of(column), f"{SPACE}+", " ")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None
) -> DataFrame:
    """One row per input row: ``<id>, keep_id, group_size, kept`` and the column ``digest`` if given.

    Rows are refined by the byte length of the normalised text, then by a hash of its first
    ``PREFIX`` code points, then by SHA-256 of all of it; a row that is alone under a key goes no
    further. Without ``digest`` the full hash is computed in a second read of the surviving
    rows only; a caller who needs the hash of every row anyway names its column. Hashes move,
    texts do not, and counts per key combine before their shuffle, so a group of any
    size stays balanced.

    Null text equals empty text. Of equal texts the smallest id stays, a null id only when the
    group has no other; of rows repeated with the same id exactly one is ``kept``. An empty
    table gives no rows. Other columns of ``docs`` are ignored, so their names cannot clash.
    """
    norm = normalised(text_col)
    columns = {
        "_id": F.col(id_col),
        "_n": F.octet_length(norm),
        "_p": F.xxhash64(F.substring(norm, 1, PREFIX)),
    }
    source = docs.select(F.col(id_col), F.col(text_col), *([digest] if digest else []))
    staged = source.select(
        *[c.alias(k) for k, c in columns.items()],
        *([F.col(digest).alias("_h")] if digest else []),
        F.monotonically_increasing_id().alias("_row"),
    )
    staged = durable(staged)

    def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")

    by_length = lookup(staged, repeated(staged, ["_n"]), ["_n"], "_c")
    alike = durable(repeated(by_length, ["_n", "_p"]))
    rows = lookup(staged, alike.withColumn("_alive", F.lit(True)), ["_n", "_p"], "_c", how="left")
    if digest is None:
        texts = source.select(*[c.alias(k) for k, c in columns.items()], norm.alias("_t"))
        hashed = lookup(texts, alike, ["_n", "_p"], "_c").select(
            "_id", "_n", "_p", F.sha2("_t", 256).alias("_h")
        )
        hashed = hashed.withColumn("_row", F.monotonically_increasing_id())
        alive = durable(hashed)
        alone = rows.filter("_alive is null").select("_id", "_row", F.lit(None).cast("string").alias("_h"))
    else:
        alive = rows.filter("_alive")
        alone = rows.filter("_alive is null")
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = alive.groupBy("_n", "_p", "_h").agg(F.count(F.lit(1)).alias("_c"), first.alias("_first"))
    groups = groups.withColumn("group_size", F.col("_c"))
    joined = lookup(alive, groups, ["_n", "_p", "_h"], "_c")
    tail = [F.col("_h").alias(digest)] if digest else []
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_first.row")).alias("kept"),
        *tail,
    ).unionByName(
        alone.select(
            F.col("_id").alias(id_col),
            F.col("_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            *tail,
        )
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id stays (ids are taken to be unique here)."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(id_col)
    return docs.join(kept, id_col, "left_semi")
