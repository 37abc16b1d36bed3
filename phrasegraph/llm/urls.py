"""URL rules by a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..plans.skew import lookup
from .common import text_of

#: A block is eight words of 64 bits; a key sets one bit in each.
WORDS = 8

#: Bits of the filter per listed key.
BITS_PER_KEY = 32


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """One bit per word, from six bits of a second hash each."""
    second = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("long")
    return F.array(*[
        F.call_function("shiftleft", one, F.call_function("shiftright", second, F.lit(7 * w)).bitwiseAND(F.lit(63)).cast("int"))
        for w in range(WORDS)
    ])


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocks ``block, words`` that hold any bit, from a table of ``key``."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("_b"))
    words = [F.bit_or(F.col("_b")[w]) for w in range(WORDS)]
    return bits.groupBy("block").agg(F.array(*words).alias("words"))


def may_hold(key: Column, words: Column) -> Column:
    bits = _bits(key)
    return F.forall(F.zip_with(words, bits, lambda w, b: w.bitwiseAND(b) == b), lambda hit: hit)


def listed(rules: DataFrame) -> DataFrame:
    """``rules`` with the canonical ``key`` of each: host, a blank, path. Of equal keys a block wins."""
    keyed = rules.select(
        F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host is not null and host <> ''")
    return keyed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn(
        "key", F.concat_ws(" ", "host", "path")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``<id>, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains if the path
    starts with the rule's; the longest key wins, then the longer host. ``rule`` is its host and
    path without the leading slash (``example.net/en/``), null if none fits; then ``verdict``
    is ``default``.

    A URL stands for one key per suffix of its host and per length of a listed path. Distinct
    hosts with paths are probed first in the blocked filter, whose blocks Spark broadcasts only
    if the written table is small, and else joins by block number; the rare hits go through an
    exact join with the list, which removes false positives. Only winners return to the pages.

    A null URL, or one without ``://``, has empty host and path and fits no rule. Rows may repeat
    and ids may be null. An empty table or an empty list works; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rules = durable(listed(rules))
    count = rules.count()
    blocks = max(1, count * BITS_PER_KEY // (64 * WORDS) + 1)
    bloom = durable(build_filter(rules, blocks))
    #: Listed paths have few lengths; a prefix of each is a possible key.
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()] or [0]
    places = durable(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n")))
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    prefixes = F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in sorted(lengths)])
    probes = (
        places.filter("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("_s"))
        .select("host", "path", "_s", F.explode(prefixes).alias("_p"))
        .filter("_p is not null")
        .select("host", "path", F.concat_ws(" ", "_s", "_p").alias("key"))
    )
    hits = (
        probes.withColumn("block", _block(F.col("key"), blocks))
        .join(bloom, "block")
        .filter(may_hold(F.col("key"), F.col("words")))
        .select("host", "path", "key")
    )
    exact = rules.select(
        "key",
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("_hl"),
        F.length("key").alias("_kl"),
    )
    best = (
        hits.join(exact, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("_kl", "_hl", "rule", "verdict")).alias("_best"))
        .select("host", "path", "_best.rule", "_best.verdict")
        .join(places, ["host", "path"])
    )
    judged = lookup(rows, best, ["host", "path"], "_n", how="left")
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
