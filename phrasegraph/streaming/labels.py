"""The labelling loop as streams: submitted sheets in, labels, used pairs and flags out.

Each stream drains what is there (``availableNow``) and keeps its place in a checkpoint, so
a restart neither loses nor repeats a submission.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import norm_rater
from ..operators.sampling import FLAGS, pair_key
from ..plans.skew import SMALL_ROWS
from ..sources.versions import current, entries, publish, write_once

#: Start of the manifest names of flag batches.
_BATCH = "batch-"


def submissions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Submitted sheets arriving as Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def clean_submissions(sheet: DataFrame) -> DataFrame:
    """Rows with a finite value as ``kw1, kw2, value, rater``."""
    value = F.col("value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return sheet.filter(finite).select(
        F.col("keyword 1").alias("kw1"),
        F.col("keyword 2").alias("kw2"),
        value.alias("value"),
        norm_rater(F.col("rater")).alias("rater"),
    )


def ingest_labels(sheet: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append clean labels to a Parquet table."""
    return (
        clean_submissions(sheet)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_used_pairs(
    sheet: DataFrame,
    phrases: DataFrame,
    out: str,
    checkpoint: str,
    event_time: str | None = None,
    keep: str = "30 days",
) -> StreamingQuery:
    """Append each (rater, pair) once.

    Without an event time the state holds every pair ever seen, which the meaning requires.
    With one, a pair seen again after ``keep`` may be written a second time.
    """
    labels = sheet.withWatermark(event_time, keep) if event_time else sheet
    value = F.col("value").cast("double")
    labels = labels.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    kids = phrases.select("phrase", "kid")
    if kids.count() <= SMALL_ROWS:
        kids = F.broadcast(kids)
    first = kids.withColumnsRenamed({"phrase": "keyword 1", "kid": "_a"})
    second = kids.withColumnsRenamed({"phrase": "keyword 2", "kid": "_b"})
    keyed = (
        labels.join(first, "keyword 1")
        .join(second, "keyword 2")
        .withColumn("rater", norm_rater(F.col("rater")))
        .withColumn("pair", pair_key(F.col("_a"), F.col("_b")))
    )
    if event_time:
        fresh = keyed.dropDuplicatesWithinWatermark(["rater", "pair"])
    else:
        fresh = keyed.select("rater", "pair").dropDuplicates(["rater", "pair"])
    return (
        fresh.select("rater", "pair")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_flags(sheet: DataFrame, order_col: str, versions: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's last edit per phrase and flag to the table ``versions``.

    A batch is named by its stream's checkpoint and its id and becomes visible when its manifest entry is
    written, so readers see whole batches and one that runs again changes nothing. ``current_flags`` folds
    all batches into the phrase table, ``compact_flags`` folds them into one.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def save(batch: DataFrame, batch_id: int) -> None:
        sides = [
            batch.select(
                F.col(f"keyword {s}").alias("phrase"),
                F.struct(F.col(order_col).alias("row_no"), F.lit(s).alias("side")).alias("at"),
                *[F.col(f"{f} {s}").cast("boolean").alias(f) for f in FLAGS],
            )
            for s in (1, 2)
        ]
        rows = sides[0].unionByName(sides[1]).filter(F.col("phrase").isNotNull())
        last = [
            c
            for f in FLAGS
            for c in (
                F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f),
                F.max(F.when(F.col(f).isNotNull(), F.col("at"))).alias(f"{f}_at"),
            )
        ]
        edits = rows.groupBy("phrase").agg(*last)
        write_once(edits, versions, f"{_BATCH}{stream}-{batch_id:012d}", stream=stream, batch=batch_id)

    return (
        sheet.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _flag_edits(spark: SparkSession, versions: str) -> tuple[DataFrame | None, dict[str, int]]:
    """The compacted edits and all batches after them, and the last batch of each stream."""
    base = current(spark, versions)
    upto = dict(base["upto"]) if base else {}
    folders = [base["folder"]] if base else []
    last = dict(upto)
    for info in entries(spark, versions, _BATCH).values():
        if info["batch"] > upto.get(info["stream"], -1):
            folders.append(info["folder"])
            last[info["stream"]] = max(info["batch"], last.get(info["stream"], -1))
    return (spark.read.parquet(*folders) if folders else None), last


def compact_flags(spark: SparkSession, versions: str) -> int | None:
    """Fold all batches so far into one table per phrase, the new current version; None without batches.

    The version says up to which batch of each stream it goes, so batches that arrive meanwhile are added to it.
    """
    edits, last = _flag_edits(spark, versions)
    if edits is None:
        return None
    folded = [c for f in FLAGS for c in (F.max_by(f, f"{f}_at").alias(f), F.max(f"{f}_at").alias(f"{f}_at"))]
    return publish(edits.groupBy("phrase").agg(*folded), versions, upto=last)


def current_flags(spark: SparkSession, phrases: DataFrame, versions: str) -> DataFrame:
    """The phrase table after all saved edits; per flag the latest edit wins. Without edits it is unchanged."""
    edits, _ = _flag_edits(spark, versions)
    if edits is None:
        return phrases
    latest = edits.groupBy("phrase").agg(*[F.max_by(f, f"{f}_at").alias(f"_{f}") for f in FLAGS])
    unique = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows = 1")
    joined = phrases.join(latest.join(unique.select("phrase"), "phrase", "left_semi"), "phrase", "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in FLAGS else F.col(c) for c in phrases.columns]
    )


