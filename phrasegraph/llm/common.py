"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here, as a Java pattern and as bytes (fixed values).
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Bytes of text whose words a task holds at a time.
SLICE = 4 << 20

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = SLICE) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes, or one row, for the jobs started inside.

    Spark's own limits (10,000 rows, 64 MB) let a batch of long rows take several hundred MB in the executor
    and its worker together. Batches cut rows otherwise and change no result.
    """
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings of an Arrow column as one byte array and ``n + 1`` offsets; null is empty."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if values.null_count:
        values = values.fill_null("" if not pa.types.is_binary(values.type) else b"")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[values.offset : values.offset + len(values) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has at most ``most`` bytes of text, or is one row."""
    for batch in batches:
        _, offsets = utf8_bytes(batch.column(column))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def fixed_words(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible 64-bit words."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each row's list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))
