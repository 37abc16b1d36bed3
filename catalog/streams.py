"""The labelling loop as streams, compared with the batch operators on the same rows.

Every line item is one submitted row. The rows are written in several files first, which is
what the file source picks up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.plans.durable import scratch_path
from phrasegraph.streaming import labels as L

from .base import query, table
from .sampling import FLAG_SQL, SQL_NAMES, edit_sheet, names


def submitted(spark, sf):
    """Stream over the submitted sheets."""
    path = scratch_path(spark, "submitted")
    rater = F.concat(F.lit(" "), F.lower("l_returnflag")).alias("rater")
    full = edit_sheet(spark, sf, rater).withColumn("value", F.when(F.col("rater") != " n", F.col("value")))
    full.repartition(4).write.parquet(path)
    return L.submissions(spark, path, full.schema)


_SHEET = "select 'P' || l_partkey as kw1, 'P' || l_suppkey as kw2, l_discount * 10 as value, l_returnflag as rater from lineitem where l_returnflag <> 'N'"


@query("l01_ingest_labels", f"select kw1, kw2, round(value, 6) as value, rater from ({_SHEET})")
def ingest_labels(spark, sf):
    out, place = scratch_path(spark, "labels"), scratch_path(spark, "place")
    L.ingest_labels(submitted(spark, sf), out, place).awaitTermination()
    return spark.read.parquet(out).withColumn("value", F.round("value", 6))


@query(
    "l02_used_pairs",
    f"""with lab as ({_SHEET}),{SQL_NAMES}
        select distinct rater, least(a.kid, b.kid) || '||' || greatest(a.kid, b.kid) as pair
        from lab join names a on a.phrase = kw1 join names b on b.phrase = kw2""",
)
def used_pairs(spark, sf):
    out, place = scratch_path(spark, "used"), scratch_path(spark, "place")
    L.stream_used_pairs(submitted(spark, sf), names(spark, sf), out, place).awaitTermination()
    return spark.read.schema("rater string, pair string").parquet(out)


def flag_phrases(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("kid"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("phrase"),
        F.lit(False).alias("omit"),
        F.lit(None).cast("boolean").alias("method"),
        F.lit(True).alias("thematic"),
    )


@query("l03_flags", FLAG_SQL)
def flags(spark, sf):
    versions, place = scratch_path(spark, "versions"), scratch_path(spark, "place")
    L.stream_flags(submitted(spark, sf), "row_no", versions, place).awaitTermination()
    return L.current_flags(spark, flag_phrases(spark, sf), versions)


@query("l03_compacted_flags", FLAG_SQL)
def compacted_flags(spark, sf):
    """Two streams of the same sheet, the first compacted before the second arrives, then both compacted."""
    versions = scratch_path(spark, "versions")
    for _ in range(2):
        L.stream_flags(submitted(spark, sf), "row_no", versions, scratch_path(spark, "place")).awaitTermination()
        L.compact_flags(spark, versions)
    return L.current_flags(spark, flag_phrases(spark, sf), versions)
