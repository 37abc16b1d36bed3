"""Keyword-phrase mining: delimited candidates, collocations, matching back, merging.

A phrase's documents are kept as rows ``phrase, doc_id, n``; nothing collects them into one
list, because a common phrase occurs in a large share of all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions.stopwords import DETERMINERS, stopword_list
from ..functions.text import word_array
from ..plans.durable import durable, settled, steps, written_bytes
from ..plans.ordering import dense_index
from ..plans.skew import lookup
from ..plans.spread import spread

#: Documents a phrase needs, counts and pointwise mutual information of a collocation.
MIN_DOC_COUNT = 5
COLLOCATION_COUNT_MIN = 5
COLLOCATION_PMI_MIN = 2.0

#: Words of a block of documents, about; a task counts and merges one block at a time.
BLOCK_WORDS = 1 << 20

#: Words (with inner hyphens) or single punctuation marks.
_SPAN_TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
#: Words or single punctuation marks, hyphens on their own.
_MARK_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def candidate_phrases(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stopwords: Sequence[str] | None = None,
    min_len: int = 2,
    max_len: int | None = None,
) -> DataFrame:
    """``id, start, length, phrase``: runs of words between stop words and punctuation.

    Every run of at least ``min_len`` words counts; ``max_len`` leaves out longer ones. The runs are found inside the row (Rose et al. 2010), so no shuffle is needed.
    """
    stop = list(stopwords if stopwords is not None else stopword_list())
    tokens = spread(docs.select(id_col, text_col), id_col).select(
        F.col(id_col), F.regexp_extract_all(F.lower(text_col), F.lit(_SPAN_TOKEN), F.lit(0)).alias("_t")
    )

    def is_break(token: Column) -> Column:
        return token.isin(stop) | ~token.rlike(r"^[\p{L}\p{N}]")

    marks = F.filter(
        F.transform("_t", lambda token, i: F.when(is_break(token), i)), lambda i: i.isNotNull()
    )
    bounded = tokens.select(
        id_col, "_t", F.concat(F.array(F.lit(-1)), marks, F.array(F.size("_t"))).alias("_b")
    )
    runs = F.zip_with(
        F.slice("_b", F.lit(1), F.size("_b") - 1),
        F.slice("_b", F.lit(2), F.size("_b") - 1),
        lambda s, e: F.struct((s + 2).alias("start"), (e - s - 1).alias("length")),
    )

    def fits(run: Column) -> Column:
        enough = run["length"] >= min_len
        return enough if max_len is None else enough & (run["length"] <= max_len)

    sized = bounded.select(id_col, "_t", F.filter(runs, fits).alias("_r"))
    spans = F.transform(
        "_r",
        lambda r: F.struct(
            r["start"].alias("start"),
            r["length"].alias("length"),
            F.array_join(F.slice("_t", r["start"], r["length"]), " ").alias("phrase"),
        ),
    )
    return sized.select(id_col, F.inline(spans))


def marked_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_document: bool = False
) -> DataFrame:
    """``id, pos, token`` with punctuation marks as tokens of their own; case kept.

    With ``by_document`` one row ``id, copies`` for each id that is not null: the token lists of its texts, so a token is not a
    row and moves once.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(_MARK_TOKEN), F.lit(0))
    texts = spread(docs.select(id_col, text_col), id_col)
    if by_document:
        lists = texts.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col), found.alias("_t"))
        return lists.groupBy(id_col).agg(F.collect_list("_t").alias("copies"))
    return texts.select(F.col(id_col), F.posexplode(found).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


def hyphen_spans(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, start, length, phrase``: every hyphen with the word after it and with the word before it.

    ``tokens`` are ``marked_tokens`` by document. Texts that share an id are taken as one set of tokens by place.
    """
    places = F.flatten(
        F.transform("copies", lambda c: F.filter(F.transform(c, lambda t, i: F.when(t == "-", i)), lambda i: i.isNotNull()))
    )

    def spans(step: int, start: int, phrase: Callable[[Column], Column]) -> Column:
        def at(i: Column) -> Column:
            near = F.filter(F.transform("copies", lambda c: F.get(c, i + step)), lambda t: t.isNotNull() & (t != "-"))
            return F.transform(
                near, lambda t: F.struct((i + start).alias("start"), F.lit(2).alias("length"), phrase(t).alias("phrase"))
            )

        return F.flatten(F.transform(places, at))

    opening = spans(1, 1, lambda t: F.concat(F.lit("-"), t))
    closing = spans(-1, 0, lambda t: F.concat(t, F.lit("-")))
    return tokens.select(id_col, F.inline(F.concat(opening, closing)))


def repair_hyphen_spans(spans: DataFrame, tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A span that starts or ends in ``-`` gains the token before or after it.

    ``tokens`` are ``marked_tokens``; those by document meet the spans of a document in one row.
    """
    opens, closes = (lambda p: p.startswith("-")), (lambda p: p.endswith("-"))
    if "copies" not in tokens.columns:
        before = tokens.select(id_col, (F.col("pos") + 1).alias("start"), F.col("token").alias("_before"))
        after = tokens.select(id_col, F.col("pos").alias("_next"), F.col("token").alias("_after"))
        opened = spans.withColumn("_next", F.col("start") + F.col("length"))
        joined = opened.join(before, [id_col, "start"], "left").join(after, [id_col, "_next"], "left")
        head = F.when(opens(F.col("phrase")), F.coalesce("_before", F.lit(""))).otherwise("")
        tail = F.when(closes(F.col("phrase")), F.coalesce("_after", F.lit(""))).otherwise("")
        return joined.select(id_col, "start", "length", F.concat(head, "phrase", tail).alias("phrase"))

    def found(place: Column) -> Column:
        """Tokens of all texts at a place (from 0); an empty one if there is none."""
        here = F.filter(F.transform("copies", lambda c: F.get(c, place)), lambda t: t.isNotNull())
        return F.when(F.size(here) > 0, here).otherwise(F.array(F.lit("")))

    def repaired(s: Column) -> Column:
        def whole(b: Column, a: Column) -> Column:
            phrase = F.concat(F.when(opens(s["phrase"]), b).otherwise(""), s["phrase"], F.when(closes(s["phrase"]), a).otherwise(""))
            return F.struct(s["start"].alias("start"), s["length"].alias("length"), phrase.alias("phrase"))

        afters = found(s["start"] + s["length"] - 1)
        return F.flatten(F.transform(found(s["start"] - 2), lambda b: F.transform(afters, lambda a: whole(b, a))))

    listed = spans.groupBy(id_col).agg(F.collect_list(F.struct("start", "length", "phrase")).alias("_s"))
    return listed.join(tokens, id_col, "left").select(id_col, F.inline(F.flatten(F.transform("_s", repaired))))


def phrase_doc_counts(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``phrase, id, n`` for normalised spans of at least two words."""
    # In an array of one the phrase is normalised once; a filter on it would be pushed down and normalise it again.
    normal = F.filter(F.array(P.normalize_phrase(F.col("phrase"))), lambda phrase: P.phrase_words(phrase) >= 2)
    return spans.select(F.col(id_col), F.explode(normal).alias("phrase")).groupBy("phrase", id_col).agg(F.count(F.lit(1)).alias("n"))


def doc_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_count"))


def frequent_postings(postings: DataFrame, min_doc_count: int = MIN_DOC_COUNT, among: DataFrame | None = None) -> DataFrame:
    """Postings ``phrase, id, n, doc_count`` of phrases found in enough documents, if given only of those ``among`` some."""
    kept = doc_counts(postings).filter(F.col("doc_count") >= min_doc_count)
    if among is not None:
        kept = kept.join(among, "phrase", "left_semi")
    return lookup(postings, kept.withColumn("_n", F.col("doc_count")), ["phrase"], "_n")


# -- collocations ------------------------------------------------------------------------
# A document stays one row with its word array, so passes move documents, not single words.


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, words``: one row per document."""
    return spread(docs.select(id_col, text_col), id_col).select(
        F.col(id_col), word_array(F.col(text_col)).alias("words")
    )


def bigrams(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, pos, a, b`` for neighbouring words, positions from 1; no shuffle."""
    n = F.size("words")
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda x, y: F.struct(x.alias("a"), y.alias("b")),
    )
    found = rows.filter(n > 1).select(F.col(id_col), F.posexplode(pairs).alias("_i", "_p"))
    return found.select(id_col, (F.col("_i") + 1).alias("pos"), F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def word_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes of all words, the words by code, words per row, and the code of each word with its next one (-1 at the end)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.full(len(codes), -1, np.int64)
    pairs[:-1] = codes[:-1] * len(coded.dictionary) + codes[1:]
    pairs[np.cumsum(sizes)[sizes > 0] - 1] = -1
    return codes, coded.dictionary, sizes, pairs


def in_blocks(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, words, _block``, written block by block; rows of one id share a block of about ``BLOCK_WORDS`` words."""
    words = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    block = F.pmod(F.xxhash64(id_col), F.lit(words // BLOCK_WORDS + 1))
    # Rows without an id are never merged, so they may lie anywhere.
    block = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64("words"), F.lit(words // BLOCK_WORDS + 1))).otherwise(block)
    return durable(rows.select(id_col, "words", block.alias("_block")).repartition("_block").sortWithinPartitions("_block"))


def grams(blocked: DataFrame) -> DataFrame:
    """``_block, a, b, n``: neighbouring words and, with ``b`` null, single words of ``_block, words``, counted per Arrow batch.

    A pair has a row per block rather than per occurrence, so no pair is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts, cuts[1:]):
                codes, names, _, pairs = _coded(batch.column(1).slice(i, j - i))
                if not len(codes):
                    continue
                found, n = np.unique(pairs[pairs >= 0], return_counts=True)
                alone = np.bincount(codes, minlength=len(names))
                first = np.concatenate([found // len(names), np.arange(len(names))])
                second = pa.array(np.concatenate([found % len(names), np.zeros(len(names), np.int64)]), mask=np.arange(len(first)) >= len(found))
                columns = [pa.array(np.full(len(first), blocks[i])), names.take(pa.array(first)), names.take(second)]
                yield pa.record_batch([*columns, pa.array(np.concatenate([n, alone]).astype(np.int64))], ["_block", "a", "b", "n"])

    return blocked.select("_block", "words").mapInArrow(run, "_block long, a string, b string, n long")


def collocations(
    rows: DataFrame,
    id_col: str = "doc_id",
    count_min: int = COLLOCATION_COUNT_MIN,
    pmi_min: float = COLLOCATION_PMI_MIN,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``a, b, n_ab, pmi`` of neighbours seen often enough; pmi = log2(n_ab N / (n_a n_b)).

    The count threshold is applied before the vocabulary joins. ``counts`` are the written ``grams`` of the rows, if known.
    """
    counts = durable(grams(rows.withColumn("_block", F.lit(0).cast("long")))) if counts is None else counts
    counted = counts.filter("b is not null").groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    counted = durable(counted.filter(F.col("n_ab") >= count_min))
    words = counts.filter("b is null").groupBy(F.col("a").alias("term")).agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum(F.size("words")).cast("double").alias("_total"))
    per_a = counted.groupBy("a").agg(F.count(F.lit(1)).alias("_w"))
    per_b = counted.groupBy("b").agg(F.count(F.lit(1)).alias("_w"))
    first = per_a.join(words.select(F.col("term").alias("a"), F.col("n").alias("n_a")), "a")
    second = per_b.join(words.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")
    n_pairs = counted.count()
    joined = lookup(lookup(counted, first, ["a"], "_w", n_pairs), second, ["b"], "_w", n_pairs)
    # The total is one row.
    scored = joined.join(F.broadcast(total)).withColumn(
        "pmi", F.log2(F.col("n_ab") * F.col("_total") / (F.col("n_a") * F.col("n_b").cast("double")))
    )
    return scored.filter(F.col("pmi") >= pmi_min).select("a", "b", "n_ab", "pmi")


def _starts(place: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether a hit at ``place`` is merged: the 1st, 3rd, 5th ... of a run; ``apart`` marks hits that open a group."""
    opens = apart.copy()
    opens[1:] |= np.diff(place) != 1
    run = place[np.maximum.accumulate(np.where(opens, np.arange(len(place)), 0))]
    return (place - run) % 2 == 0


def _merged_words(ids: pa.Array, lists: pa.ListArray, a: pa.Array, b: pa.Array) -> pa.ListArray:
    """The rows' words with the pairs ``a, b`` merged. Rows that share an id share their hits; without an id nothing is merged."""
    codes, names, sizes, pairs = _coded(lists)
    known = [pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False) for x in (a, b)]
    known = np.array(known, float)[:, ~np.isnan(np.array(known, float)).any(axis=0)].astype(np.int64)
    hit = np.isin(pairs, known[0] * len(names) + known[1])
    owner = ids.dictionary_encode().indices
    owner = pc.fill_null(owner, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    shared = (np.bincount(owner + 1, minlength=len(ids) + 2) > 1)[owner + 1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    hit &= owner[row] >= 0
    at = np.flatnonzero(hit)
    own = at[~shared[row[at]]]
    start = np.zeros(len(codes), bool)
    start[own[_starts(own, np.zeros(len(own), bool) | (np.arange(len(own)) == 0))]] = True
    kept = np.ones(len(codes), bool)
    kept[np.flatnonzero(start) + 1] = False
    merged, which = np.unique(pairs[start], return_inverse=True)
    glue = [names.take(pa.array(merged // max(1, len(names)))), names.take(pa.array(merged % max(1, len(names))))]
    texts = pa.concat_arrays([names, pc.binary_join_element_wise(*glue, pa.scalar("_", names.type))])
    codes[start] = len(names) + which
    lengths = np.bincount(row[kept], minlength=len(sizes))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), texts.take(pa.array(codes[kept])).cast(pa.string()))
    common = np.flatnonzero(shared & (owner >= 0))
    if not len(common):
        return out
    starts = defaultdict(list)
    at = at[shared[row[at]]]
    place = at - before[row[at]] + 1
    order = np.lexsort((place, owner[row[at]]))
    who, place = owner[row[at]][order], place[order]
    for o, p in zip(who[(s := _starts(place, np.r_[True, np.diff(who) != 0][: len(who)]))].tolist(), place[s].tolist()):
        starts[o].append(p)
    whole = out.to_pylist()
    for r in common.tolist():
        w, mine = lists[r].as_py() or [], starts[int(owner[r])]
        gone = {p for q in mine for p in (q, q + 1)}
        pieces = [(p, "_".join(w[p - 1 : p + 1])) for p in mine] + [(p, x) for p, x in enumerate(w, 1) if p not in gone]
        whole[r] = [x for _, x in sorted(pieces)]
    return pa.array(whole, pa.list_(pa.string()))


def merge_pairs(
    rows: DataFrame,
    found: DataFrame,
    id_col: str = "doc_id",
    found_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``id, words``: each document's words with accepted pairs as ``a_b``, left to right and without overlap.

    In a run of consecutive hits the 1st, 3rd, 5th ... pair is merged. Each block of documents gets the accepted pairs that
    occur in it, so nothing is moved per word. ``rows`` with ``_block`` come from ``in_blocks`` and keep that column, ``counts`` are their ``grams``.
    """
    if "_block" not in rows.columns:
        plain = merge_pairs(in_blocks(rows, id_col), found, id_col, found_rows)
        return plain.select(id_col, "words")
    counts = grams(rows) if counts is None else counts
    found_rows = found.count() if found_rows is None else found_rows
    here = _possible_pairs(counts.filter("b is not null").select("_block", "a", "b"), found, found_rows)
    accepted = found.select("a", "b", "n_ab")
    here = lookup(here, accepted, ["a", "b"], "n_ab", found_rows).select("_block", "a", "b")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        flat = [pa.concat_arrays(docs.column(c).chunks) for c in (id_col, "words")]
        text = flat[1].type.value_type
        a, b = (pa.concat_arrays([pa.array([], text), *(x.cast(text) for x in pairs.column(c).chunks)]) if pairs.num_rows else pa.array([], text) for c in ("a", "b"))
        return pa.table({id_col: flat[0], "words": _merged_words(*flat, a, b), "_block": docs.column("_block")})

    return rows.groupBy("_block").cogroup(here.groupBy("_block")).applyInArrow(run, f"`{id_col}` {kind}, words array<string>, _block long")


def collocation_rows(
    rows: DataFrame,
    id_col: str = "doc_id",
    count_min: int = COLLOCATION_COUNT_MIN,
    pmi_min: float = COLLOCATION_PMI_MIN,
    passes: int = 2,
) -> DataFrame:
    """Word rows after ``passes`` rounds of learning and merging pairs (up to 2^passes words).

    Of the steps only the last rows stay; the rows of a round go as soon as those of the next are written.
    """
    if not passes:
        return rows
    with steps(rows.sparkSession) as whole:
        plain = rows if written_bytes(rows) is not None else durable(rows)
        rows = in_blocks(plain, id_col)
        whole.drop(plain)
        for left in reversed(range(passes)):
            with steps(rows.sparkSession) as scope:
                # The rows that are written come block by block.
                counts = durable(grams(rows))
                found = durable(collocations(rows, id_col, count_min, pmi_min, counts))
                merged = merge_pairs(rows, found, id_col, found.count(), counts)
                merged = scope.keep(merged) if left else whole.keep(merged)
            whole.drop(rows)
            rows = merged
        return rows.select(id_col, "words")


def collocation_terms(merged: DataFrame) -> DataFrame:
    """``term, n`` of merged terms not led by a determiner."""
    lead = "|".join(DETERMINERS)
    return word_counts(merged).filter(
        F.contains("term", F.lit("_")) & ~F.col("term").rlike(f"^({lead})_")
    )


def trimmed_terms(terms: DataFrame, stopwords: Sequence[str] | None = None) -> DataFrame:
    """``phrase, n``: terms with blanks, stop words stripped at both ends, two words or more."""
    stop = list(stopwords if stopwords is not None else stopword_list())
    plain = P.trim_stopwords(F.translate("term", "_", " "), stop)
    return (
        terms.select(plain.alias("phrase"), "n")
        .filter(F.contains("phrase", F.lit(" ")))
        .groupBy("phrase")
        .agg(F.sum("n").alias("n"))
    )


# -- matching, merging, numbering ---------------------------------------------------------


#: Factor of the rolling hash over the hashes of words.
_ROLL = np.uint64(0x9E3779B97F4A7C15)

#: Bits of the filter for each phrase, and the most it has (as a power of two). A full filter lets more runs through, never fewer.
FILTER_BITS, FILTER_MOST = 64, 27


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of rolling hashes."""
    return ((hashes ^ (hashes >> np.uint64(29))) * _ROLL) >> np.uint64(64 - bits)


def _known(known: np.ndarray, rolled: np.ndarray) -> np.ndarray:
    """Whether the filter has the bits of rolling hashes."""
    place = _place(rolled, len(known).bit_length() + 2)
    return known[place >> np.uint64(3)] & _bit(place) != 0


def _word_blocks(batch: pa.RecordBatch, words: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about so many ``words`` of its second column."""
    load = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // words
    cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(load)]
    yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def _bit(place: np.ndarray) -> np.ndarray:
    """The bit of a place within its byte."""
    return np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8))


def _filter(frame: DataFrame, n_rows: int, rolled: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Bits set at the places of the hashes of all rows; a hash whose place is not set is of none of them."""
    bits = min(FILTER_MOST, max(10, (n_rows * FILTER_BITS).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for hashes in rolled(batch):
                place = _place(hashes, bits)
                np.bitwise_or.at(mine, place >> np.uint64(3), _bit(place))
        yield pa.record_batch([pa.array([mine.tobytes()])], ["bits"])

    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in frame.mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], np.uint8)
    return whole


def _phrase_filter(phrases: DataFrame, n_phrases: int) -> np.ndarray:
    """Filter of ``phrase`` by the hashes of its words."""

    def rolled(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        lists = pc.split_pattern(batch.column(0).drop_null(), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        hashes, first = _word_hashes(lists.flatten()), np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            at = first[sizes == n]
            found = hashes[at]
            for k in range(1, n):
                found = found * _ROLL + hashes[at + k]
            yield found

    return _filter(phrases.select("phrase"), n_phrases, rolled)


def _pair_hashes(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (_word_hashes(pc.fill_null(batch.column(c), "")) for c in ("a", "b"))
    return a * _ROLL + b


def _possible_pairs(pairs: DataFrame, found: DataFrame, n_found: int) -> DataFrame:
    """``pairs`` without most of those whose ``a, b`` is not in ``found``."""
    known = _filter(found.select("a", "b"), n_found, lambda batch: iter([_pair_hashes(batch)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(_known(known, _pair_hashes(batch))))

    return pairs.mapInArrow(run, pairs.schema)


def ngrams(
    docs: DataFrame,
    lengths: Sequence[int],
    id_col: str = "doc_id",
    text_col: str = "text",
    among: DataFrame | None = None,
    n_among: int = 0,
) -> DataFrame:
    """``id, phrase, n``: the runs of as many words as ``lengths`` say, counted inside the row.

    With ``among`` (``n_among`` rows with ``phrase``) runs that a filter knows not to be one of its phrases are never built; a few others pass.
    """
    words = spread(docs.select(id_col, text_col), id_col).select(
        F.col(id_col), word_array(F.col(text_col)).alias("_w")
    )
    known = None if among is None else _phrase_filter(among, n_among)
    kind = docs.schema[id_col].dataType.simpleString()

    def runs(ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        codes, names, sizes, _ = _coded(lists)
        hashes = _word_hashes(names)[codes] if known is not None else None
        row = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        rows, texts, rolled = [], [], hashes
        for n in range(1, max(lengths, default=0) + 1):
            if rolled is not None and n > 1:
                rolled = rolled[: max(0, len(codes) - n + 1)] * _ROLL + hashes[n - 1 :]
            if n not in lengths:
                continue
            at = np.flatnonzero(left >= n)
            if rolled is not None:
                at = at[_known(known, rolled[at])]
            offsets = pa.array(np.arange(len(at) + 1) * n, pa.int32())
            parts = names.take(pa.array(codes[(at[:, None] + np.arange(n)).ravel()]))
            texts.append(pc.binary_join(pa.ListArray.from_arrays(offsets, parts.cast(pa.string())), " "))
            rows.append(row[at])
        phrases = pa.concat_arrays([pa.array([], pa.string()), *texts]).dictionary_encode()
        code = phrases.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        several = max(1, len(phrases.dictionary))
        found, count = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]) * several + code, return_counts=True)
        columns = [ids.take(pa.array(found // several)), phrases.dictionary.take(pa.array(found % several)), pa.array(count.astype(np.int64))]
        return pa.record_batch(columns, [id_col, "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _word_blocks(batch, BLOCK_WORDS):
                yield runs(block.column(0), block.column(1))

    return words.mapInArrow(run, f"`{id_col}` {kind}, phrase string, n long")


def phrase_matches(
    phrases: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_doc_count: int = MIN_DOC_COUNT,
    lengths: Sequence[int] | None = None,
) -> DataFrame:
    """``phrase, id, n, doc_count``: occurrences per document, on word bounds.

    ``phrases`` is ``phrase, n`` with ``n`` the phrase's rough frequency, used only to keep
    the join balanced. Phrases of all lengths are matched unless ``lengths`` names some.
    """
    found = durable(phrases.groupBy("phrase").agg(F.max("n").alias("_n")))
    if lengths is None:
        # One number per phrase length that occurs.
        sizes = found.select(F.size(F.split("phrase", " ")).alias("n")).distinct()
        lengths = sorted(r["n"] for r in sizes.collect()) or [1]
    n_found = found.count()
    hits = lookup(ngrams(docs, lengths, id_col, text_col, found, n_found), found, ["phrase"], "_n", n_found)
    per_doc = durable(hits.groupBy("phrase", id_col).agg(F.sum("n").alias("n")))
    return frequent_postings(per_doc, min_doc_count)


#: Combinations of word ends looked at, and about as many words of documents, at a time.
ENDS_HELD = 1 << 19


def _ends(names: pa.Array, lengths: Sequence[int], known: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word where its ends begin and how many it has, and all ends: those of ``lengths`` that the filter lets through."""
    sizes = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    owner, texts = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for n in lengths:
        at = np.flatnonzero(sizes >= n)
        words = names.take(pa.array(at))
        if not n:
            cut = pa.array([""] * len(at), pa.string())
        else:
            cut = pc.utf8_slice_codeunits(words, start=-n) if last else pc.utf8_slice_codeunits(words, start=0, stop=n)
        kept = _known(known, _word_hashes(cut))
        owner.append(at[kept])
        texts.append(cut.filter(pa.array(kept)).cast(pa.string()))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(names))
    return np.cumsum(count) - count, count, pa.concat_arrays(texts).take(pa.array(order))


def _without_overlap(group: np.ndarray, pos: np.ndarray, tight: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Occurrences of each group (from 0, ascending, then by ``pos``) that count from left to right.

    One may begin in the word in which the last one ended unless it is ``tight``.
    """
    count = np.bincount(group)
    gap = np.diff(pos) - (m[1:] - 1)
    close = (np.diff(group) == 0) & ((gap < 0) | ((gap == 0) & tight[1:]))
    for g in np.unique(group[1:][close]).tolist():
        lo, hi = np.searchsorted(group, [g, g + 1])
        n, end = 0, -1
        for p, t, k in zip(pos[lo:hi].tolist(), tight[lo:hi].tolist(), m[lo:hi].tolist()):
            if p > end or (p == end and not t):
                n, end = n + 1, p + k - 1
        count[g] = n
    return count


def _inner_matches(
    ids: pa.Array, lists: pa.ListArray, sizes: Sequence[int], ends: tuple[Sequence[int], Sequence[int]], known: Sequence[np.ndarray]
) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, phrases and counts of strings that the filters ``known`` (phrases, first and last words) let through, row by row."""
    codes, names, words, _ = _coded(lists)
    if not len(codes):
        return
    names = names.cast(pa.string())
    hashes = _word_hashes(names)[codes]
    row = np.repeat(np.arange(len(words)), words)
    left = np.repeat(np.cumsum(words), words) - np.arange(len(codes))
    start = np.cumsum(words) - words
    tails, heads = (_ends(names, n, f, last) for n, f, last in ((ends[0], known[1], True), (ends[1], known[2], False)))
    tail_hash, head_hash = _word_hashes(tails[2]), _word_hashes(heads[2])
    length, tail_length, head_length = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, tails[2], heads[2]))
    texts, found = [], []
    middle = np.zeros(len(codes), np.uint64)
    for m in range(2, max(sizes, default=1) + 1):
        if m > 2:
            # The words between, as the filter rolls them.
            middle = middle[: max(0, len(codes) - m + 1)] * _ROLL + hashes[m - 2 : len(codes) - 1]
        if m not in sizes:
            continue
        at = np.flatnonzero(left >= m)
        n_tails, n_heads = tails[1][codes[at]], heads[1][codes[at + m - 1]]
        at = at[n_tails * n_heads > 0]
        load = np.cumsum(tails[1][codes[at]] * heads[1][codes[at + m - 1]]) // ENDS_HELD
        cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            first, last = codes[at[lo:hi]], codes[at[lo:hi] + m - 1]
            n = tails[1][first] * heads[1][last]
            which = np.repeat(np.arange(hi - lo), n)
            rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            wide = heads[1][last][which]
            tail, head = tails[0][first][which] + rank // np.maximum(wide, 1), heads[0][last][which] + rank % np.maximum(wide, 1)
            rolled = tail_hash[tail]
            for _ in range(m - 1):
                rolled = rolled * _ROLL
            hit = np.flatnonzero(_known(known[0], rolled + middle[at[lo:hi]][which] * _ROLL + head_hash[head]))
            tail, head, place = tail[hit], head[hit], at[lo:hi][which[hit]]
            between = [names.take(pa.array(codes[place + k])) for k in range(1, m - 1)]
            texts.append(pc.binary_join_element_wise(tails[2].take(pa.array(tail)), *between, heads[2].take(pa.array(head)), " "))
            tight = length[codes[place]] < tail_length[tail] + head_length[head]
            found.append((row[place], place - start[row[place]], tight, np.full(len(place), m)))
    phrases = pa.concat_arrays([pa.array([], pa.string()), *texts]).dictionary_encode()
    if not len(phrases):
        return
    code = phrases.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows, pos, tight, m = (np.concatenate(x) for x in zip(*found))
    key = rows * len(phrases.dictionary) + code
    order = np.lexsort((pos, key))
    each, group = np.unique(key[order], return_inverse=True)
    count = _without_overlap(group, pos[order], tight[order], m[order])
    yield ids.take(pa.array(each // len(phrases.dictionary))), phrases.dictionary.take(pa.array(each % len(phrases.dictionary))), count


def substring_matches(
    phrases: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_doc_count: int = MIN_DOC_COUNT,
) -> DataFrame:
    """``phrase, id, n, doc_count``: occurrences inside a document's words joined by blanks, without overlap.

    The first word of a phrase may end a longer word and the last one begin one: ``data set`` is found in
    ``metadata settings``. Inside a document's row the ends of its words are combined where filters know the first word,
    the last word and the whole; what passes is held against the phrases, so a filter only saves work and no word is moved.
    Occurrences count from left to right as a text search does. Phrases of one word and nulls are left out;
    rows that share an id count together.
    """
    words = F.split("phrase", " ")
    found = phrases.select("phrase").distinct().filter(F.size(words) > 1)
    found = durable(
        found.select("phrase", F.size(words).alias("_m"), F.element_at(words, 1).alias("_f"), F.element_at(words, -1).alias("_l"))
    )
    n_found = found.count()

    def distinct(column: Column) -> list[int]:
        return sorted(r["n"] for r in found.select(column.alias("n")).distinct().collect())

    sizes, ends = distinct(F.col("_m")), (distinct(F.length("_f")), distinct(F.length("_l")))
    known = [_phrase_filter(found.select(F.col(c).alias("phrase")), n_found) for c in ("phrase", "_f", "_l")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _word_blocks(batch, ENDS_HELD):
                for ids, texts, n in _inner_matches(block.column(0), block.column(1), sizes, ends, known):
                    yield pa.record_batch([ids, texts, pa.array(n.astype(np.int64))], [id_col, "phrase", "n"])

    hits = word_rows(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, phrase string, n long")
    per_doc = durable(hits.groupBy("phrase", id_col).agg(F.sum("n").alias("n")))
    return frequent_postings(per_doc, min_doc_count, found)


def noun_side(postings: DataFrame, id_col: str = "doc_id", min_doc_count: int = MIN_DOC_COUNT) -> DataFrame:
    """Noun postings with hyphens as blanks, recounted so that each phrase is unique."""
    # Read twice, to count the documents and to keep the frequent ones.
    plain = durable(
        postings.select(P.plain_phrase(F.col("phrase")).alias("phrase"), id_col, "n")
        .groupBy("phrase", id_col)
        .agg(F.sum("n").alias("n"))
    )
    return frequent_postings(plain, min_doc_count)


def merge_candidates(colloc: DataFrame, noun: DataFrame) -> DataFrame:
    """``phrase, doc_count, source``: full join of both sides, the collocation side wins."""
    left = colloc.groupBy("phrase").agg(F.max("doc_count").alias("_c"))
    right = noun.groupBy("phrase").agg(F.max("doc_count").alias("_d"))
    source = (
        F.when(F.col("_c").isNull(), "nounphrase")
        .when(F.col("_d").isNull(), "collocation")
        .otherwise("collocation+nounphrase")
    )
    return left.join(right, "phrase", "full").select(
        "phrase", F.coalesce("_c", "_d").alias("doc_count"), source.alias("source")
    )


def drop_bad_phrases(
    phrases: DataFrame, stopwords: Sequence[str] | None = None, check_end: bool = False
) -> DataFrame:
    """Drop empty phrases and those led (optionally ended) by a stop word."""
    stop = list(stopwords if stopwords is not None else stopword_list())
    bad = (F.col("phrase") == "") | P.starts_with_stopword(F.col("phrase"), stop)
    if check_end:
        bad = bad | P.ends_with_stopword(F.col("phrase"), stop)
    return phrases.filter(~bad)


def assign_kid(phrases: DataFrame) -> DataFrame:
    """Add ``kid``: the phrase's 1-based place in phrase order, as a string; flags are false."""
    numbered = dense_index(phrases, ["phrase"], "kid").withColumn("kid", F.col("kid").cast("string"))
    for flag in ("omit", "method", "thematic"):
        numbered = numbered.withColumn(flag, F.lit(False))
    return numbered


def candidate_table(
    colloc: DataFrame, noun: DataFrame, id_col: str = "doc_id", stopwords: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The phrase table ``kid, phrase, doc_count, source, flags`` and its postings ``kid, id, n``."""
    phrases = durable(assign_kid(drop_bad_phrases(merge_candidates(colloc, noun), stopwords)))
    keys = phrases.select("phrase", "kid", "source", F.col("doc_count").alias("_n"))
    from_colloc = lookup(colloc.drop("doc_count"), keys.filter("source <> 'nounphrase'"), ["phrase"], "_n")
    from_noun = lookup(noun.drop("doc_count"), keys.filter("source = 'nounphrase'"), ["phrase"], "_n")
    postings = from_colloc.unionByName(from_noun).select("kid", id_col, "n")
    return phrases, postings


def mine_phrases(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_doc_count: int = MIN_DOC_COUNT,
    stopwords: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole mining stage: documents to phrase table and postings."""
    docs = docs.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    spark = docs.sparkSession

    def nouns() -> DataFrame:
        spans = candidate_phrases(docs, id_col, text_col, stopwords)
        counted = durable(phrase_doc_counts(spans, id_col))
        return noun_side(frequent_postings(counted, min_doc_count), id_col, min_doc_count)

    def matched() -> DataFrame:
        merged = collocation_rows(word_rows(docs, id_col, text_col), id_col)
        terms = settled(spark, lambda: trimmed_terms(collocation_terms(merged), stopwords))
        return phrase_matches(terms, docs, id_col, text_col, min_doc_count)

    noun = settled(spark, nouns)
    colloc = settled(spark, matched)
    return candidate_table(colloc, noun, id_col, stopwords)
