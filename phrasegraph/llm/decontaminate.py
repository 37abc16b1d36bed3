"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed_words, mix64, slices, text_of, utf8_bytes
from .shingles import _PLACE, word_bounds, word_hashes

#: Text bytes of benchmark items that one pass over the documents carries.
BLOCK_BYTES = 16 << 20

#: Positions of an embedding that one table samples.
SAMPLED = 6

#: Trials per size when the number of tables is set.
TRIALS = 64

#: Windows embedded at a time.
WINDOWS = 4096


def embed(words: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """CGK random walks over the rows of ``words``, each of its own length: ``3 * width`` symbols a row.

    At step j the walk writes the word it stands on and moves on if a random bit of (j, word) says so; past the
    end it writes 0. Rows with few edits between them fall into step again, so their outputs
    differ in few places.
    """
    n, width = words.shape
    steps = fixed_words(1000 + seed, 3 * width)
    padded = np.concatenate([words, np.zeros((n, 1), np.uint64)], axis=1)
    row, at = np.arange(n), np.zeros(n, np.int64)
    out = np.zeros((n, 3 * width), np.uint64)
    for j in range(3 * width):
        here = padded[row, at]
        out[:, j] = here
        at = np.minimum(at + (mix64(here ^ steps[j]) & np.uint64(1)).astype(np.int64), lengths)
    return out


def table_keys(embedded: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """One key a row from ``SAMPLED`` positions, drawn within three times the row's length."""
    picks = (fixed_words(5000 + seed, SAMPLED) >> np.uint64(11)).astype(float) / 2.0**53
    key = lengths.astype(np.uint64)
    row = np.arange(len(embedded))
    for u in picks:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + embedded[row, (u * 3 * lengths).astype(np.int64)])
    return key


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Fewest word edits between ``item`` and any stretch of ``text``, and where that stretch ends (bit-parallel)."""
    n = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = full, 0, n
    best, end = n, 0
    for at, w in enumerate(text, 1):
        eq = where.get(w, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        plus, minus = (down | ~(d | up)) & full, up & d
        edits += bool(plus & high) - bool(minus & high)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        if edits < best:
            best, end = edits, at
    return best, end


@dataclass
class Items:
    """A block of benchmark items: word hashes, allowed edits, seeds by length and table keys."""

    ids: list
    words: np.ndarray
    lengths: np.ndarray
    edits: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    keys: np.ndarray
    tables: np.ndarray

    @staticmethod
    def of(rows: list[tuple[object, str]], rate: float, recall: float) -> Items:
        texts = pa.array([t for _, t in rows], pa.string())
        data, offsets = utf8_bytes(texts)
        starts, ends, counts = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        begin = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        lengths = counts[some]
        words = np.zeros((len(some), int(lengths.max(initial=1))), np.uint64)
        for r, i in enumerate(some):
            words[r, : counts[i]] = hashes[begin[i] : begin[i] + counts[i]]
        # One word at least may always differ in items of four words or more.
        edits = np.maximum((lengths * rate).astype(np.int64), (lengths >= 4).astype(np.int64))
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for r in range(len(some)):
            size = int(lengths[r] // (edits[r] + 1))
            for k in range(int(edits[r]) + 1):
                code = int(_rolled(words[r, k * size : (k + 1) * size], size)[0])
                pieces.setdefault(size, []).append((code, r, k * size))
        seeds = {}
        for size, found in pieces.items():
            found.sort()
            codes = np.array([c for c, _, _ in found], np.uint64)
            seeds[size] = (codes, np.array([r for _, r, _ in found]), np.array([o for _, _, o in found]))
        tables = _tables_needed(words, lengths, edits, recall)
        most = int(tables.max(initial=1))
        keys = np.zeros((most, len(some)), np.uint64)
        for t in range(most):
            keys[t] = table_keys(embed(words, lengths, t), lengths, t)
        return Items([rows[i][0] for i in some], words, lengths, edits, seeds, keys, tables)


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        total += words[k : k + n] * (_PLACE[k % len(_PLACE)] + np.uint64(2 * (k // len(_PLACE))))
    return mix64(total)


def _tables_needed(words: np.ndarray, lengths: np.ndarray, edits: np.ndarray, recall: float) -> np.ndarray:
    """Tables per item so that an item with all its allowed edits shares one with probability ``recall``.

    The chance of a single table is measured per item length by random edits of an item of that length.
    """
    out = np.ones(len(lengths), np.int64)
    draw = np.random.default_rng(7)
    for n in np.unique(lengths):
        r = int(np.flatnonzero(lengths == n)[0])
        k = int(edits[r])
        if not k:
            continue
        changed = np.zeros((TRIALS, n), np.uint64)
        for t in range(TRIALS):
            row = list(words[r, :n])
            for _ in range(k):
                kind, at = draw.integers(3), int(draw.integers(len(row)))
                new = np.uint64(draw.integers(2**63))
                if kind == 0:
                    row[at] = new
                elif kind == 1:
                    row.insert(at, new)
                elif len(row) > 1:
                    del row[at]
            row = (row + [np.uint64(draw.integers(2**63)) for _ in range(n)])[:n]
            changed[t] = row
        same = np.repeat(words[r : r + 1, :n], TRIALS, axis=0)
        sizes = np.full(TRIALS, n)
        hits = [
            (table_keys(embed(changed, sizes, s), sizes, s) == table_keys(embed(same, sizes, s), sizes, s)).mean()
            for s in range(8)
        ]
        p = max(float(np.mean(hits)), 1 / (8 * TRIALS))
        out[lengths == n] = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 1 - 1e-9))))
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.15,
    recall: float = 0.99,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``<id>, item_id, edits, first_byte, end_byte``: the best place of each item that a document holds.

    An item is held if some stretch of the text differs from it in ``rate`` of its words at most (one word in
    items of four words or more, none in shorter ones); words are runs without white space, A-Z
    lower-cased. Every document is read whole, once per block of items.

    1. An item with k edits allowed is cut into k + 1 pieces; a stretch within k edits holds one
       of them unchanged, so only windows around an equal run of words need embedding.
    2. Item-sized windows at every shift those edits allow are embedded by CGK random walks,
       which turn edit into Hamming distance, and compared by bit-sampling tables. Each
       item has as many walks and tables as its length and k need to reach ``recall``.
    3. Windows that share a table key are verified by exact edit distance.

    Items go to the tasks in blocks of ``block_bytes`` of text, so a benchmark of any size is handled with a
    fixed broadcast; nothing is shuffled but the matches. Null or empty texts and items hold and match nothing.
    Rows that repeat an id give one row per item. Ids may be null. Empty tables give no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t"))
    items = benchmark.filter("text is not null and text <> ''").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = Items.of([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], rate, recall)
        one = rows.mapInArrow(_search(block), "_id long, _item long, edits int, first_byte long, end_byte long")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("_id", "_item").agg(F.min(F.struct("edits", "first_byte", "end_byte")).alias("_b"))
    return best.select(
        F.col("_id").alias(id_col), F.col("_item").alias("item_id"), "_b.edits", "_b.first_byte", "_b.end_byte"
    )


def _search(items: Items):
    """The task over Arrow batches of ``_id, _t``."""
    names = ["_id", "_item", "edits", "first_byte", "end_byte"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            data, offsets = utf8_bytes(batch.column(1))
            starts, ends, counts = word_bounds(data, offsets)
            words = word_hashes(data, starts, ends)
            after = np.cumsum(counts)
            out = {}
            for doc, item, window in _candidates(items, words, after):
                begin, end = int(after[doc] - counts[doc]), int(after[doc])
                k, n = int(items.edits[item]), int(items.lengths[item])
                lo, hi = max(begin, window - k), min(end, window + n + 2 * k)
                edits, stop = best_match(items.words[item, :n].tolist(), words[lo:hi].tolist())
                if edits <= k:
                    back, length = best_match(items.words[item, :n][::-1].tolist(), words[lo : lo + stop][::-1].tolist())
                    at = (edits, int(starts[lo + stop - length] - offsets[doc]), int(ends[lo + stop - 1] - offsets[doc]))
                    out[doc, item] = min(out.get((doc, item), at), at)
            rows = [(ids[doc], items.ids[item], *at) for (doc, item), at in out.items()]
            yield pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], names)

    return run


def _candidates(items: Items, words: np.ndarray, after: np.ndarray) -> list[tuple[int, int, int]]:
    """Distinct (document, item, first word) of windows that share a table key with the item."""
    doc_of, item_of, first_of = [], [], []
    for size, (codes, item, offset) in items.seeds.items():
        rolled = _rolled(words, size)
        lo = np.searchsorted(codes, rolled, "left")
        hit = np.flatnonzero((lo < len(codes)) & (codes[np.minimum(lo, len(codes) - 1)] == rolled))
        if not len(hit):
            continue
        lo, hi = lo[hit], np.searchsorted(codes, rolled[hit], "right")
        each = np.repeat(np.arange(len(hit)), hi - lo)
        seed = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        at = hit[each]
        doc = np.searchsorted(after, at, "right")
        inside = at + size <= after[doc]
        at, doc, seed = at[inside], doc[inside], seed[inside]
        k = items.edits[item[seed]]
        shifts = np.repeat(np.arange(len(at)), 2 * k + 1)
        step = np.arange(len(shifts)) - np.repeat(np.cumsum(2 * k + 1) - (2 * k + 1), 2 * k + 1) - k[shifts]
        doc_of.append(doc[shifts])
        item_of.append(item[seed][shifts])
        first_of.append(at[shifts] - offset[seed][shifts] + step)
    if not doc_of:
        return []
    every = np.unique(np.stack([np.concatenate(x) for x in (doc_of, item_of, first_of)]), axis=1)
    width = items.words.shape[1]
    begins = np.concatenate([[0], after[:-1]])
    out = []
    for lo in range(0, every.shape[1], WINDOWS):
        doc, item, first = every[:, lo : lo + WINDOWS]
        n = items.lengths[item]
        place = first[:, None] + np.arange(width)
        real = (place >= begins[doc][:, None]) & (place < after[doc][:, None]) & (np.arange(width) < n[:, None])
        window = np.where(real, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
        open_ = np.arange(len(doc))
        for t in range(len(items.keys)):
            open_ = open_[items.tables[item[open_]] > t]
            if not len(open_):
                break
            keys = table_keys(embed(window[open_], n[open_], t), n[open_], t)
            same = keys == items.keys[t][item[open_]]
            out += [(int(doc[i]), int(item[i]), int(first[i])) for i in open_[same]]
            open_ = open_[~same]
    # One window per document, item and neighbourhood is enough: verification reads around it.
    out.sort()
    kept: list[tuple[int, int, int]] = []
    for doc, item, first in out:
        if kept and kept[-1][:2] == (doc, item) and first - kept[-1][2] <= 1:
            continue
        kept.append((doc, item, first))
    return kept
