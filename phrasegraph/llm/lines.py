"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..plans.skew import lookup
from .common import SPACE_BYTES, text_of

#: Stands for a null id in comparisons: below every other.
_NO_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (bytes: other letters stay)."""
    return line.strip(SPACE_BYTES).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    r"""One row per input row: ``<id>, <text>, n_lines, n_dropped``, the text without repeated lines.

    Lines are cut at ``\n``, normalised to a key and hashed to 128 bits. Keys of at least
    ``min_chars`` code points found in ``min_docs`` documents lose all their lines except in the
    largest id holding them; the others keep their order. One pass emits each document's
    distinct hashes, which are counted with map-side combining; only hashes over the threshold
    go back to their documents, so whole texts are read twice and lines never move.

    Null or empty text is one empty line. A null id ranks below every id, and every row with a
    null id counts as a document of its own. Rows that share an id count as one document and keep
    or lose a key together. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), text_of(text_col).alias("_t"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_buffer().to_pybytes()
                keys = {line_key(x) for x in body.split(b"\n") if len(x) >= min_chars}
                found = [xxhash.xxh3_128_digest(k) for k in keys if _code_points(k) >= min_chars]
                out += found
                ids += [doc] * len(found)
                if len(out) >= 200_000:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["_id", "_h"])
                    ids, out = [], []
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["_id", "_h"])

    occurrences = durable(rows.mapInArrow(hashes, "_id long, _h binary"))
    # Hashes are counted by row; what rows of a repeated id counted too often is taken off again.
    shared = rows.filter(F.col("_id") != _NO_ID).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    surplus = (
        lookup(occurrences, shared, ["_id"], "_n")
        .groupBy("_h", "_id")
        .agg((F.count(F.lit(1)) - 1).alias("_more"))
        .groupBy("_h")
        .agg(F.sum("_more").alias("_more"))
    )
    counted = (
        occurrences.groupBy("_h")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
        .filter(F.col("_n") >= min_docs)
    )
    repeated = (
        counted.join(surplus, "_h", "left")
        .filter(F.col("_n") - F.coalesce("_more", F.lit(0)) >= min_docs)
        .drop("_more")
    )
    drops = (
        lookup(occurrences, repeated, ["_h"], "_n")
        .filter("_id < _keep")
        .groupBy("_id")
        .agg(F.collect_set("_h").alias("_drop"))
    )
    drops = durable(drops)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = text.as_buffer().to_pybytes()
                parts = body.split(b"\n")
                lines.append(len(parts))
                if drop:
                    gone = set(drop)
                    kept = [
                        x
                        for x in parts
                        if len(x) < min_chars or xxhash.xxh3_128_digest(line_key(x)) not in gone
                    ]
                    dropped.append(len(parts) - len(kept))
                    body = b"\n".join(kept)
                else:
                    dropped.append(0)
                texts.append(body.decode())
            yield pa.record_batch(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                ["_id", "_t", "n_lines", "n_dropped"],
            )

    rebuilt = rows.join(drops, "_id", "left").select("_id", "_t", "_drop").mapInArrow(
        rebuild, "_id long, _t string, n_lines long, n_dropped long"
    )
    return rebuilt.select(
        F.when(F.col("_id") != _NO_ID, F.col("_id")).alias(id_col), F.col("_t").alias(text_col), "n_lines", "n_dropped"
    )
