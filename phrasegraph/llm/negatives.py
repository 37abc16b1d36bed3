"""Hard negatives by exact inner products; candidates are packed into wide integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable, steps
from .codes import as_integers, usable

#: Anchors that a task holds at most, about, with the best rows found for each.
ANCHORS = 16_384

#: Scores worked on at a time: anchors times rows.
ANCHOR_BLOCK, ROW_BLOCK = 512, 4_096

#: Bits of an integer that a double holds exactly.
EXACT_BITS = 53

#: Sorts behind all ids and stands for a null id.
_NO_ID = 2**63 - 1

_LEAST = np.iinfo(np.int64).min


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices, one multiplication per anchor component and wide integer.

    Components are biased to be at least zero. A field of ``bits`` bits holds any biased product, so
    fields of several rows stand side by side in one integer without carries: a wide integer times an anchor
    component is the products of all its rows, and their sum over components is unpacked by shifts. The biases
    are taken out at the end.

    Where two fields or more fit into 53 bits, the wide integers are carried by doubles, in which all sums
    are still exact, and the matrix product does the multiplications. Larger components use
    Python integers with the fields of all rows in one.
    """
    low_a, low_r = int(anchors.min(initial=0)), int(rows.min(initial=0))
    a, r = anchors - low_a, rows - low_r
    most = sum(x * y for x, y in zip(a.max(axis=0, initial=0).tolist(), r.max(axis=0, initial=0).tolist()))
    bits = max(1, most.bit_length())
    fields = EXACT_BITS // bits
    out = np.empty((len(a), len(r)), np.int64)
    if fields >= 2:
        mask = (1 << bits) - 1
        wide = np.zeros((-(-len(r) // fields), r.shape[1]), np.int64)
        for k in range(fields):
            part = r[k::fields]
            wide[: len(part)] |= part << (bits * k)
        product = (a.astype(np.float64) @ wide.T.astype(np.float64)).astype(np.int64)
        for k in range(fields):
            part = out[:, k::fields]
            part[:] = ((product >> (bits * k)) & mask)[:, : part.shape[1]]
    else:
        size = -(-bits // 8)
        wide = []
        for column in r.T:
            raw = np.zeros((len(r), size), np.uint8)
            raw[:, : min(8, size)] = np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8)[:, : min(8, size)]
            wide.append(int.from_bytes(raw.tobytes(), "little"))
        for i, anchor in enumerate(a.tolist()):
            total = sum(x * w for x, w in zip(anchor, wide))
            raw = np.frombuffer(total.to_bytes(size * len(r), "little"), np.uint8).reshape(len(r), size)
            low = np.zeros((len(r), 8), np.uint8)
            low[:, : min(8, size)] = raw[:, :8]
            out[i] = low.reshape(-1).view(np.int64)
    # Sums beyond 64 bits cancel: everything is modulo 2 ** 64 and the scores themselves fit.
    out += low_r * a.sum(axis=1)[:, None] + low_a * r.sum(axis=1)[None, :] + a.shape[1] * low_a * low_r
    return out


class Best:
    """The ``k`` best rows for each of ``keys`` keys: highest score first, ties by smaller id."""

    def __init__(self, keys: int, k: int):
        self.score = np.full((keys, k), _LEAST)
        self.id = np.full((keys, k), _NO_ID)
        self.found = np.zeros(keys, np.int64)

    def least(self) -> np.ndarray:
        """The score that a further row needs at least, per key."""
        return self.score[:, -1]

    def offer(self, key: int, score: np.ndarray, ids: np.ndarray) -> None:
        have = self.found[key]
        score = np.concatenate([self.score[key, :have], score])
        ids = np.concatenate([self.id[key, :have], ids])
        order = np.lexsort((ids, -score))[: self.score.shape[1]]
        self.found[key] = len(order)
        self.score[key, : len(order)], self.id[key, : len(order)] = score[order], ids[order]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), max(1, sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _wider(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


class Lane:
    """The anchors of one lane, past which its rows are streamed."""

    def __init__(self, parts: list[pa.RecordBatch], k: int, positives: int | None, band: tuple[int, int]):
        table = pa.Table.from_batches(parts)
        self.row, self.id = table["row"].to_numpy(), table["id"].to_numpy()
        self.label = np.array(table["label"].to_pylist(), object)
        self.vectors = _matrix(table["q"].combine_chunks())
        self.searching = positives is None
        self.slots = 1 if positives is None else positives
        keys = len(self.row) * self.slots
        self.high, self.low = np.full(keys, _LEAST), np.zeros(keys, np.int64)
        self.positive_id = np.zeros(keys, np.int64)
        self.positive_score = np.zeros(keys, np.int64)
        if not self.searching:
            for i, known in enumerate(table["known"].to_pylist()):
                for j, pair in enumerate(known or []):
                    key, score = i * self.slots + j, pair["score"]
                    self.positive_id[key], self.positive_score[key] = pair["id"], score
                    self.low[key] = -((-score * band[0]) // 100)
                    self.high[key] = (score * band[1]) // 100
        self.best = Best(keys, k)

    def meet(self, batch: pa.RecordBatch) -> None:
        for at in range(0, len(batch), ROW_BLOCK):
            piece = batch.slice(at, ROW_BLOCK)
            row, ids = piece.column("row").to_numpy(), piece.column("id").to_numpy()
            values, codes = np.unique(np.array(piece.column("label").to_pylist(), object), return_inverse=True)
            place = {v: i for i, v in enumerate(values)}
            vectors = _matrix(piece.column("q"))
            width = max(vectors.shape[1], self.vectors.shape[1])
            self.vectors, vectors = _wider(self.vectors, width), _wider(vectors, width)
            mine = np.array([place.get(v, -1) for v in self.label])
            for lo in range(0, len(self.row), ANCHOR_BLOCK):
                hi = min(lo + ANCHOR_BLOCK, len(self.row))
                scores = packed_scores(self.vectors[lo:hi], vectors)
                alike = mine[lo:hi, None] == codes[None, :]
                if self.searching:
                    self._offer(lo, 0, scores, alike & (self.row[lo:hi, None] != row[None, :]), ids)
                else:
                    for j in range(self.slots):
                        keys = np.arange(lo, hi) * self.slots + j
                        inside = (scores <= self.high[keys, None]) & (scores >= self.low[keys, None])
                        self._offer(lo, j, scores, inside & ~alike, ids)

    def _offer(self, lo: int, slot: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        keys = np.arange(lo, lo + len(scores)) * self.slots + slot
        allowed &= scores >= self.best.least()[keys, None]
        for i in np.flatnonzero(allowed.any(axis=1)):
            hit = np.flatnonzero(allowed[i])
            self.best.offer(keys[i], scores[i, hit], ids[hit])

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["anchor_row", "anchor", "slot", "positive", "positive_score", "found", "score"]
        for lo in range(0, len(self.best.found), ROW_BLOCK):
            found = self.best.found[lo : lo + ROW_BLOCK]
            key = np.repeat(np.arange(lo, lo + len(found)), found)
            nth = np.arange(len(key)) - np.repeat(np.cumsum(found) - found, found)
            anchor = key // self.slots
            columns = [self.row[anchor], self.id[anchor], key % self.slots, self.positive_id[key], self.positive_score[key]]
            columns += [self.best.id[key, nth], self.best.score[key, nth]]
            yield pa.record_batch([pa.array(c) for c in columns], names)


def _scanned(rows: DataFrame, anchors: DataFrame, k: int, positives: int | None, band: tuple[int, int]) -> DataFrame:
    """The ``k`` best partners of every anchor (and positive) within each lane.

    Anchors are cut into slices of about ``ANCHORS`` and rows into groups; a lane is a slice with a group. A row
    goes to one lane of each slice, an anchor to one lane of each group. Inside its lane the anchors come first;
    the rows stream past them, so a task holds one slice and a block of rows. Rows are dealt by their
    number, so equal rows or ids spread evenly.
    """
    spark = rows.sparkSession
    slices = max(1, -(-anchors.count() // ANCHORS))
    groups = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // slices))
    dealt = F.xxhash64("row")
    first = anchors.withColumn("kind", F.lit(0)).withColumn(
        "lane",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.pmod(dealt, F.lit(slices)) * groups + g)),
    )
    then = rows.withColumn("kind", F.lit(1)).withColumn(
        "lane",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: s * groups + F.pmod(dealt, F.lit(groups)))),
    )
    columns = ["lane", "kind", "row", "id", "label", "q"] + ([] if positives is None else ["known"])
    both = first.select(*columns).unionByName(then.select(*[c for c in columns if c != "known"]), allowMissingColumns=True)
    both = both.repartition(slices * groups, "lane").sortWithinPartitions("lane", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, waiting, now = None, [], None
        for batch in batches:
            mark = batch.column("lane").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(mark)) + 1, [len(mark)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                if mark[lo] >> 1 != lane:
                    if now is not None:
                        yield from now.rows()
                    lane, waiting, now = mark[lo] >> 1, [], None
                if mark[lo] & 1 == 0:
                    waiting.append(batch.slice(lo, hi - lo))
                elif waiting or now is not None:
                    if now is None:
                        now, waiting = Lane(waiting, k, positives, band), []
                    now.meet(batch.slice(lo, hi - lo))
        if now is not None:
            yield from now.rows()

    names = "anchor_row anchor slot positive positive_score found score".split()
    return both.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _id(column: str) -> Column:
    return F.when(F.col(column) != _NO_ID, F.col(column))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(256 * x)``; scores are integer inner products, higher first and ties by smaller
    id. Rows with ``anchor`` true are the queries. An anchor's positives are its ``positives`` best other rows of
    its label; for each of them the ``negatives`` best rows of other labels are returned whose score is from
    ``band[0]`` to ``band[1]`` percent of the positive's. All anchors meet all rows, in blocks (``_scanned``), twice:
    first for the positives, whose scores then set the bands.

    Rows without label or vector, or with a null or non-finite component, take no part. A null id is behind
    all ids in a tie (the largest 64-bit id counts as null). Equal rows and repeated ids are rows of
    their own: a row is never its own positive, but a copy of it can be. Shorter vectors count as zero beyond their end, and
    components over ``codes.LIMIT`` count as the limit. Anchors without positives or negatives give no rows;
    so does an empty table. Other columns are ignored.
    """
    with steps(vectors.sparkSession) as scope:
        rows = vectors.filter(usable(vec_col) & F.col(label_col).isNotNull())
        rows = rows.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
            F.col(label_col).alias("label"),
            as_integers(vec_col).alias("q"),
            F.coalesce(anchor, F.lit(False)).alias("_anchor"),
        )
        rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
        anchors = rows.filter("_anchor")
        near = _first(_scanned(rows, anchors, positives, None, band), ["anchor_row"], positives)
        known = durable(
            near.groupBy(F.col("anchor_row").alias("row"))
            .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("found").alias("id"), "score"))).alias("known"))
        )
        far = _scanned(rows, durable(anchors.join(known, "row")), negatives, positives, band)
        far = _first(far, ["anchor_row", "slot"], negatives)
        return scope.keep(
            far.select(
                _id("anchor").alias("anchor_id"),
                _id("positive").alias("positive_id"),
                F.col("rank").cast("int").alias("rank"),
                _id("found").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
