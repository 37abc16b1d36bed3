"""Input assertions. Each returns a one-row DataFrame; ``require`` turns it into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: Sequence[str], where: str) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"{where}: missing required columns: {missing}")
    return df


def violations(df: DataFrame, key: str, not_null: Sequence[str] = ()) -> DataFrame:
    """Row count, null counts of the given columns and number of repeated keys."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null],
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_if((F.col("_n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in not_null],
    )


def require(df: DataFrame, key: str, not_null: Sequence[str], where: str) -> DataFrame:
    """Raise unless ``df`` is non-empty with a unique key and no nulls; one small job."""
    row = violations(df, key, not_null).first().asDict()
    if row.pop("n_rows") == 0:
        raise ValueError(f"{where}: no rows")
    broken = {name: n for name, n in row.items() if n}
    if broken:
        raise ValueError(f"{where}: {broken}")
    return df


def require_rows(df: DataFrame, where: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{where}: no rows after filtering")
    return df
