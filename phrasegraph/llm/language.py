"""Language identification with Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .common import text_of

#: Characters per n-gram; four symbols of 16 bits fill one 64-bit hash.
ORDER = 4

#: Characters handled at a time within a text.
BLOCK = 1 << 20

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The 16-bit symbol of each code point: itself for letters of the first plane, a fold for others, 0 else."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    folded = np.where(points < 0x10000, points, 0xE000 + points % 0x1900)
    return np.where(letter, folded, 0).astype(np.uint16)


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters with each run of anything else as one 0, and a 0 at both ends; empty if no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    raw = _symbols()[points]
    if not raw.any():
        return np.zeros(0, np.uint16)
    raw = np.concatenate([np.zeros(1, np.uint16), raw, np.zeros(1, np.uint16)])
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
    return raw[keep]


def grams(found: np.ndarray) -> np.ndarray:
    """The hash of the last four symbols at every position after the first; zeros stand before the text."""
    padded = np.concatenate([np.zeros(ORDER - 2, np.uint64), found.astype(np.uint64)])
    n = len(found) - 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | padded[k : k + n]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts of ``docs(_lang, _t)``; each Arrow batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending: dict[str, list[np.ndarray]] = {}
            held = 0
            for i in range(len(batch)):
                found = symbols(batch.column(1)[i].as_py() or "")
                if not len(found):
                    continue
                pending.setdefault(batch.column(0)[i].as_py(), []).append(grams(found))
                held += len(found)
                if held >= 4 * BLOCK or i == len(batch) - 1:
                    yield from flush(pending)
                    pending, held = {}, 0
            yield from flush(pending)

    def flush(pending: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in pending.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)],
                ["lang", "gram", "n"],
            )

    counted = docs.select("_lang", "_t").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _interpolated(codes: np.ndarray, n: np.ndarray, order: int, lower: tuple[np.ndarray, np.ndarray] | None, vocabulary: int):
    """Probabilities of one order and the weight each history gives the order below.

    ``lower`` has the sorted codes and probabilities of the order below. ``n`` are counts at the top order,
    continuation counts below.
    """
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    histories, at = np.unique(codes >> np.uint64(16), return_inverse=True)
    total = np.bincount(at, n)
    kinds = np.bincount(at)
    give = discount * kinds / total
    if lower is None:
        below = np.full(len(codes), 1 / vocabulary)
    else:
        mask = np.uint64((1 << (16 * (order - 1))) - 1)
        below = lower[1][np.searchsorted(lower[0], codes & mask)]
    p = np.maximum(n - discount, 0) / total[at] + give[at] * below
    return p, histories, give


@dataclass
class Model:
    """Per order (4 down to 1) sorted hashes with log-probabilities per language, and history weights."""

    langs: list[str]
    codes: list[np.ndarray]
    logs: list[np.ndarray]
    histories: list[np.ndarray]
    gives: list[np.ndarray]
    floor: float
    sharpness: float = 10.0
    limits: dict[str, float] | None = None

    def position_logs(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each position under each language, backing off where no language knows the n-gram."""
        out = np.empty((len(codes), len(self.langs)), np.float32)
        todo = np.arange(len(codes))
        carried = np.zeros((len(codes), len(self.langs)), np.float32)
        current = codes
        for order in range(ORDER, 0, -1):
            i = ORDER - order
            table = self.codes[i]
            at = np.minimum(np.searchsorted(table, current), len(table) - 1)
            hit = table[at] == current
            out[todo[hit]] = self.logs[i][at[hit]] + carried[hit]
            if hit.all():
                return out
            todo, current, carried = todo[~hit], current[~hit], carried[~hit]
            history = current >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.histories[i], history), len(self.histories[i]) - 1)
            known = self.histories[i][at] == history
            carried = carried + np.where(known[:, None], self.gives[i][at], 0)
            if order > 1:
                current = current & np.uint64((1 << (16 * (order - 1))) - 1)
        out[todo] = self.floor + carried
        return out

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Cross-entropy per character under each language, and the number of characters."""
        found = symbols(text)
        if not len(found):
            return np.zeros(len(self.langs)), 0
        codes = grams(found)
        total = np.zeros(len(self.langs))
        for lo in range(0, len(codes), BLOCK):
            total += self.position_logs(codes[lo : lo + BLOCK]).sum(axis=0, dtype=np.float64)
        return -total / len(codes), len(codes)

    def confidence(self, entropies: np.ndarray) -> np.ndarray:
        """Share of the best language in a softmax whose sharpness was fitted on labelled texts."""
        best = entropies.min(axis=1, keepdims=True)
        return 1 / np.exp(-(entropies - best) * self.sharpness).sum(axis=1)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from the 4-gram counts of each language."""
    langs = sorted(counts)
    vocabulary = len(np.unique(np.concatenate([c & np.uint64(0xFFFF) for c, _ in counts.values()]))) + 1
    per_lang: dict[str, list] = {}
    for lang in langs:
        codes, n = counts[lang]
        tables = [(codes, n.astype(float))]
        for order in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (16 * order)) - 1)
            lower, kinds = np.unique(tables[-1][0] & mask, return_counts=True)
            tables.append((lower, kinds.astype(float)))
        solved, below = [], None
        for order, (lower, kinds) in zip(range(1, ORDER + 1), reversed(tables), strict=True):
            p, histories, give = _interpolated(lower, kinds, order, below, vocabulary)
            below = (lower, p)
            solved.append((lower, p, histories, give))
        per_lang[lang] = solved[::-1]
    model = Model(langs, [], [], [], [], float(-np.log(vocabulary)))
    # From the lowest order up, so that a language without an n-gram has its backed-off value ready.
    for order in range(1, ORDER + 1):
        i = ORDER - order
        union = np.unique(np.concatenate([per_lang[x][i][0] for x in langs]))
        hist = np.unique(np.concatenate([per_lang[x][i][2] for x in langs]))
        gives = np.zeros((len(hist), len(langs)), np.float32)
        logs = np.zeros((len(union), len(langs)), np.float32)
        for k, lang in enumerate(langs):
            codes, p, histories, give = per_lang[lang][i]
            gives[np.searchsorted(hist, histories), k] = np.log(np.maximum(give, 1e-12))
            if order == 1:
                below = np.full(len(union), model.floor)
            else:
                tail = union & np.uint64((1 << (16 * (order - 1))) - 1)
                below = model.logs[0][np.searchsorted(model.codes[0], tail), k]
            logs[:, k] = below + gives[np.searchsorted(hist, union >> np.uint64(16)), k]
            logs[np.searchsorted(union, codes), k] = np.log(p)
        model.codes.insert(0, union)
        model.logs.insert(0, logs)
        model.histories.insert(0, hist)
        model.gives.insert(0, gives)
    return model


def _entropy_rows(rows: DataFrame, model: Model) -> DataFrame:
    """``_id, _lang, _e, _n`` of ``rows(_id, _lang, _t)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [model.entropies(t.as_py() or "") for t in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([e.tolist() for e, _ in results], pa.list_(pa.float64())),
                    pa.array([n for _, n in results], pa.int64()),
                ],
                ["_id", "_lang", "_e", "_n"],
            )

    return rows.select("_id", "_lang", "_t").mapInArrow(run, "_id long, _lang string, _e array<double>, _n long")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 modulo 3."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
    return F.coalesce(rest == 1, F.lit(False))


def fit(
    train: DataFrame,
    reject_share: float = 0.005,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """A model from all rows of ``train`` with a language; None if no such row has a letter.

    4-grams are counted over every whole text and all of them enter the model, so discounts, histories and
    continuation counts are those of the corpus. The model is built on the driver and grows with the
    distinct 4-grams. The sharpness of the
    confidence and, per language, the entropy that the worst ``reject_share`` of its texts exceed
    are fitted on all rows.
    """
    rows = train.filter(F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang"), text_of(text_col).alias("_t")
    )
    counted = durable(count_grams(rows))
    kept = counted.toPandas()
    if kept.empty:
        return None
    counts = {}
    for lang, part in kept.groupby("lang"):
        codes = part["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(codes)
        counts[lang] = (codes[order], part["n"].to_numpy()[order])
    model = build(counts)
    # Every row counts; one row of sums and one of limits reach the driver.
    seen = durable(_entropy_rows(rows, model).filter("_n > 0").select("_lang", "_e"))
    least = F.array_min("_e")
    place = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("_lang"))
    steps = [float(x) for x in 2.0 ** np.arange(0, 8, 0.5)]

    def loss(sharpness: float) -> Column:
        odds = F.transform("_e", lambda e: F.exp((F.col("_least") - e) * F.lit(sharpness)))
        total = F.aggregate(odds, F.lit(0.0), lambda x, y: x + y)
        return F.avg(-F.log(F.exp((F.col("_least") - F.col("_own")) * F.lit(sharpness)) / total + F.lit(1e-9)))

    placed = seen.select("_lang", "_e", least.alias("_least"), F.element_at("_e", place.cast("int")).alias("_own"))
    losses = placed.agg(*[loss(x).alias(f"_{i}") for i, x in enumerate(steps)]).first()
    if losses[0] is not None:
        model.sharpness = min(zip(losses, steps))[1]
        right = seen.filter(F.array_position("_e", least) == place)
        edges = right.groupBy("_lang").agg(F.percentile(F.element_at("_e", place.cast("int")), F.lit(1 - reject_share)).alias("_q"))
        model.limits = {r["_lang"]: r["_q"] for r in edges.collect()}
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, lang_pred, score, entropy, rejected`` for every row, from its whole text alone.

    The language of lowest cross-entropy per character wins, ties by name. ``rejected`` marks texts whose entropy
    exceeds what labelled texts of that language show. Null, empty or letterless
    text is ``und`` with score 0 and null entropy, and is rejected; so is every text without a
    model. Rows may repeat, ids may be null, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.lit("").alias("_lang"), text_of(text_col).alias("_t"))
    if model is None:
        return rows.select(
            F.col("_id").alias(id_col),
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"),
            F.lit(True).alias("rejected"),
        )
    limits = model.limits or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            results = [model.entropies(t.as_py() or "") for t in batch.column(1)]
            entropies = np.array([e for e, _ in results])
            some = np.array([n > 0 for _, n in results])
            best = entropies.argmin(axis=1)
            names = [model.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            low = entropies[np.arange(len(best)), best]
            out = [not s or e > limits.get(x, np.inf) for x, e, s in zip(names, low, some, strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(names, pa.string()),
                    pa.array(np.where(some, model.confidence(entropies), 0.0)),
                    pa.array(low, mask=~some),
                    pa.array(out, pa.bool_()),
                ],
                ["_id", "lang_pred", "score", "entropy", "rejected"],
            )

    schema = "_id long, lang_pred string, score double, entropy double, rejected boolean"
    return rows.select("_id", "_t").mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def learn_and_predict(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Predictions for every row with a model learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out(id_col)), id_col=id_col)
    found = predict(docs, model, id_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
