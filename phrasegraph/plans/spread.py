"""Give CPU-heavy row work enough tasks when the input has few file splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` only if the scan has fewer splits than the session has cores.

    A large input has many splits and is returned unchanged, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
