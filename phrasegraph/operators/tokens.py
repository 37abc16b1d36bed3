"""Words, vocabulary and term-weight encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_array
from ..plans.spread import spread


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``id, pos, term``, positions from 1."""
    return docs.select(
        F.col(id_col), F.posexplode(word_array(F.col(text_col))).alias("pos", "term")
    ).withColumn("pos", F.col("pos") + 1)


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: bool = False) -> DataFrame:
    """Term-frequency vectors in long form: ``id, term, w``.

    All words of a document are in one row, so the partial aggregate is already complete
    before the shuffle. ``together`` deals the texts out by their id first, where that is smaller than the counts: then these
    are grouped by document as they are and need no shuffle.
    """
    docs = docs.select(id_col, text_col)
    docs = docs.repartition(id_col) if together else spread(docs, id_col)
    words = docs.select(F.col(id_col), F.explode(word_array(F.col(text_col))).alias("term"))
    return words.groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("w"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """``term, term_count, doc_count`` from long term vectors (one row per document and term)."""
    return counts.groupBy("term").agg(
        F.sum("w").cast("long").alias("term_count"), F.count(F.lit(1)).alias("doc_count")
    )


def tfidf(counts: DataFrame, n_docs: int, id_col: str = "doc_id") -> DataFrame:
    """Weights ``tf * ln((N + 1) / (df + 1))`` in long form."""
    from ..plans.skew import lookup

    doc_freq = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).withColumn("df", F.col("_n"))
    idf = F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1))
    return lookup(counts, doc_freq, ["term"], "_n").select(
        id_col, "term", (F.col("w") * idf).alias("w")
    )


Encoder = Callable[[list[str]], "list[list[float]]"]


def encode_with(
    docs: DataFrame, make_encoder: Callable[[], Encoder], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Dense vectors ``id, vec`` from a user model, loaded once per Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.DataFrame(
                {id_col: batch[id_col], "vec": [list(map(float, v)) for v in encoder(batch[text_col].tolist())]}
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, vec array<double>")
