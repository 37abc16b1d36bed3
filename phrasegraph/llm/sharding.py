"""Reproducible shuffle into shards by a permutation of the row numbers."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..plans.ordering import dense_index
from .common import text_of

#: The modulus of the round function, the prime 2^31 - 1: products stay below 2^63.
PRIME = 2_147_483_647
ROUNDS = 6

#: Most steps of a walk. The domain exceeds n by less than its smaller side (about the root of n),
#: so a step leaves the range with probability about 1/sqrt(n); a walk that is still outside
#: raises an error instead of giving a wrong number.
WALK = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an addend below ``PRIME`` per round."""
    digests = [hashlib.sha256(f"{seed}|{i}".encode()).digest() for i in range(rounds)]
    return [
        (int.from_bytes(d[:4], "big") % (PRIME - 1) + 1, int.from_bytes(d[4:8], "big") % PRIME) for d in digests
    ]


def sides(n: int) -> tuple[int, int]:
    """The two sides of the domain, ``a * b >= n`` with as little excess as possible."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(number: int, n: int, seed: int) -> int:
    """Where row ``number`` of ``n`` goes; the same arithmetic as the column expression."""
    a, b = sides(n)
    while True:
        left, right = number // b, number % b
        size, other = a, b
        for mul, add in round_keys(seed):
            mixed = (right * mul + add) % PRIME
            left, right = right, (left + mixed * mixed % PRIME) % size
            size, other = other, size
        number = left * other + right if size == a else left * size + right
        if number < n:
            return number


def feistel(number: Column, n: int, seed: int) -> Column:
    """``permute`` as a column: an unbalanced Feistel network with cycle walking.

    A state is ``left * b + right`` with ``left < a`` and ``right < b``. Each round swaps the halves
    and adds a keyed function of the one to the other, modulo its side; the number of rounds is
    even, so the sides end as they began.
    """
    a, b = sides(n)
    keys = F.array(*[
        F.struct(
            F.lit(mul).cast("long").alias("mul"),
            F.lit(add).cast("long").alias("add"),
            F.lit(a if i % 2 == 0 else b).cast("long").alias("size"),
        )
        for i, (mul, add) in enumerate(round_keys(seed))
    ])

    def one_round(state: Column, key: Column) -> Column:
        mixed = (state["right"] * key["mul"] + key["add"]) % F.lit(PRIME)
        return F.struct(
            state["right"].alias("left"),
            ((state["left"] + mixed * mixed % F.lit(PRIME)) % key["size"]).alias("right"),
        )

    def step(x: Column) -> Column:
        begin = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("left"), (x % F.lit(b)).alias("right"))
        return F.aggregate(keys, begin, one_round, lambda s: s["left"] * F.lit(b) + s["right"])

    inside = F.lit(n).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK)), step(number), lambda x, _: F.when(x < inside, x).otherwise(step(x))
    )
    return F.when(walked < inside, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def assign_shards(
    docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``<id>, size, text_crc32, row_number, position, shard, slot`` for every row of ``docs``.

    Rows are numbered 0 to n - 1 by id, then size, then checksum of the text; the Feistel
    permutation sends number to ``position``; ``shard = position % shards`` and
    ``slot = position div shards``. So shards differ by one row at most, slots have no gaps, and
    shard and slot of a row follow from its number, n and the seed alone (``permute``).

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` that of the bytes (null as
    empty). A null id sorts first. Equal rows get different numbers; which gets which makes
    no difference. An empty table gives no rows; other columns are ignored. Only
    DataFrame functions run; no text is shuffled.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered = durable(dense_index(rows, ["_id", "size", "text_crc32"], "row_number", 0))
    n = numbered.count()
    if n == 0:
        position = F.lit(None).cast("long")
    else:
        position = feistel(F.col("row_number"), n, seed)
    placed = numbered.withColumn("position", position)
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        "row_number",
        "position",
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
    )
