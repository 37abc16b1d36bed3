"""The registered queries: each derives the agreed columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, sql, toxicity
from .codes import compress
from .common import table
from .decontaminate import find_leaks
from .exact import exact_duplicates, normalised
from .lines import drop_repeated_lines
from .minhash import near_duplicates
from .mixing import mix
from .negatives import hard_negatives
from .sharding import assign_shards
from .suffixes import drop_repeats
from .urls import judge_urls, rule_table
from .wrappers import main_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return register


@query("op1_mixing", sql.MIXING)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select(
        "doc_id",
        F.col("mix_source").alias("source"),
        F.col("mix_lang").alias("lang"),
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"),
        F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_sampled").alias("sampled"),
    )


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_predict(table(spark, sf_dir, "documents"))


@query("op3_minhash", sql.NEAR)
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_line_dedup", sql.LINES)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_exact_dedup", sql.EXACT)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.withColumn("text_sha256", F.sha2(normalised(), 256))
    return exact_duplicates(hashed, digest="text_sha256")


@query("op6_toxicity")
def toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The agreed rules: host, path, verdict (fixed values).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query("op7_url_filters", sql.urls(URL_RULES))
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


@query("op8_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_sharding", sql.sharding(shards=8, seed=42))
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), shards=8, seed=42)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_vector_codes", sql.codes())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


@query("op12_hard_negatives", sql.NEGATIVES)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The agreed labels: every seventh row counts as the next class.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op13_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
