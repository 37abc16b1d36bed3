"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .common import text_of

# The seed words of the grammar.
INSULTS = (
    "clown coward creep cretin crybaby disgusting dumb filth fool idiot imbecile jerk liar loser moron pathetic"
    " repulsive scum stupid trash ugly vermin worthless"
    " abschaum dummkopf erbärmlich idiotin trottel widerlich"
    " crétin débile imbécile minable ordure"
    " basura escoria estúpido imbécil patético"
).split()
THREATS = "destroy hurt kill murder punch shoot stab strangle töten umbringen tuer frapper matar golpear".split()
TARGETS = (
    "he her him she them they this those you your yourself"
    " du dich ihr euch sie tu toi vous ils elle usted tú ellos"
).split()
NEGATIONS = "ain isn never no nobody none not wasn weren without kein keine nicht nie aucun jamais pas sans jamás nunca sin".split()
REPORTS = (
    "alleged called claimed quoted reported said says shouted wrote"
    " behauptete sagte schrieb cria disait écrit dijo escribió gritó"
).split()

#: Input symbols of the transducers.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)

#: Words after a negation, and after a target, that they still reach; words before a target that it reaches.
NEGATION_REACH, TARGET_REACH, AHEAD_REACH = 3, 4, 3

#: Documents with this score or more count as toxic.
THRESHOLD = 0.3

#: What a clause can match; the weight is the prior for one such match (fixed values).
FEATURES = {
    ("insult", False, False): 3.0,
    ("insult", True, False): 3.5,
    ("insult", False, True): 1.0,
    ("insult", True, True): 1.5,
    ("threat", False, False): 0.5,
    ("threat", True, False): 4.0,
    ("threat", False, True): 0.0,
    ("threat", True, True): 0.5,
}
NAMES = list(FEATURES)

#: Added for a match without a target before it that has one after it: kind, whether reported (fixed values).
AHEAD = {("insult", False): 0.5, ("insult", True): 0.5, ("threat", False): 3.5, ("threat", True): 0.5}
AHEAD_NAMES = list(AHEAD)

#: Sums of weights that one insult or one directed threat, unreported and unnegated, is scored by.
DECISIVE = (
    [NAMES.index(("insult", False, False))],
    [NAMES.index(("insult", True, False))],
    [NAMES.index(("threat", True, False))],
    [NAMES.index(("threat", False, False)), len(NAMES) + AHEAD_NAMES.index(("threat", False))],
)

def inflected(words: Iterable[str]) -> set[str]:
    """The words with regular plural, case, gender and comparative endings; words under four letters as they are."""
    out = set(words)
    for word in [w for w in out if len(w) >= 4]:
        out |= {word + end for end in ("s", "es", "e", "en", "n", "em")}
        if word.endswith("lich"):
            out.add(word + "er")
        if word.endswith("y"):
            out |= {word[:-1] + end for end in ("ies", "ier", "iest")}
        if word.endswith("o"):
            out |= {word[:-1] + end for end in ("a", "as")}
        if word.endswith("in"):
            out.add(word + "nen")
    return out


CLAUSE_END = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: ``step(state, symbol)`` gives the next state and the output symbol."""

    start: object
    step: Callable[[object, object], tuple[object, object]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def step(state, symbol):
            mine, theirs = state
            mine, out = self.step(mine, symbol)
            theirs, out = other.step(theirs, out)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def _negating() -> Transducer:
    """Cancels insults and threats that a negation reaches: writes them as other words."""

    def step(left, symbol):
        if symbol == NEGATION:
            return NEGATION_REACH, symbol
        hit = left > 0 and symbol in (INSULT, THREAT)
        return max(0, left - 1), OTHER if hit else symbol

    return Transducer(0, step)


def _reporting() -> Transducer:
    """Pairs each symbol with whether it stands after a report verb or inside quotes."""

    def step(state, symbol):
        said, quoted = state
        if symbol == QUOTE:
            quoted = not quoted
        return (said or symbol == REPORT, quoted), (symbol, said or quoted)

    return Transducer((False, False), step)


def _targeting() -> Transducer:
    """Writes a feature for each insult or threat: kind, whether a target is near, whether reported."""

    def step(left, pair):
        symbol, reported = pair
        if symbol == TARGET:
            return TARGET_REACH, None
        kind = {INSULT: "insult", THREAT: "threat"}.get(symbol)
        return max(0, left - 1), (kind, left > 0, reported) if kind else None

    return Transducer(0, step)


def compiled(machine: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """All states reachable as tables ``next[state][symbol]`` and ``feature[state][symbol]`` (-1: none)."""
    number, todo, following, written = {machine.start: 0}, [machine.start], [], []
    for state in todo:
        moves, outs = [], []
        for symbol in range(7):
            target, out = machine.step(state, symbol)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            moves.append(number[target])
            outs.append(NAMES.index(out) if out is not None else -1)
        following.append(moves)
        written.append(outs)
    return following, written


@dataclass
class Model:
    """Word weights per class and feature weights; ``bias`` is the log-odds of a text with no match."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    weights: list[float] = field(default_factory=lambda: [*FEATURES.values(), *AHEAD.values()])
    bias: float = -3.0

    @cached_property
    def classes(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            out |= dict.fromkeys(words, symbol)
        out |= dict.fromkeys('"“”„«»', QUOTE)
        return out | dict.fromkeys(self.insults, INSULT)

    @cached_property
    def tables(self):
        return compiled(_negating().then(_reporting()).then(_targeting()))

    @cached_property
    def finder(self):
        found = ahocorasick.Automaton()
        for word in [*self.insults, *THREATS]:
            found.add_word(word, len(word))
        found.make_automaton()
        return found

    def features(self, text: str) -> np.ndarray:
        """How much of each of ``NAMES`` the clauses of a text match."""
        return self.matches(text)[: len(NAMES)]

    def matches(self, text: str) -> np.ndarray:
        """``features``, then ``AHEAD_NAMES``; only clauses with a trigger word are read, once in each direction."""
        total = np.zeros(len(NAMES) + len(AHEAD_NAMES))
        low = text.lower()
        hits = [end for end, _ in self.finder.iter(low)]
        if not hits:
            return total
        cuts = [(m.start(), m.end()) for m in CLAUSE_END.finditer(low)]
        starts = [0] + [e for _, e in cuts]
        ends = [s for s, _ in cuts] + [len(low)]
        following, written = self.tables
        for i in sorted({bisect.bisect_right(starts, h) - 1 for h in hits}):
            state, read = 0, []
            for word in TOKEN.findall(low, starts[i], ends[i]):
                symbol = self.classes.get(word, OTHER)
                out = written[state][symbol]
                amount = self.insults.get(word, 1.0) if out >= 0 else 0.0
                if out >= 0:
                    total[out] += amount
                read.append((symbol, out, amount))
                state = following[state][symbol]
            left = 0
            for symbol, out, amount in reversed(read):
                if out >= 0 and left > 0:
                    kind, directed, reported = NAMES[out]
                    if not directed:
                        total[len(NAMES) + AHEAD_NAMES.index((kind, reported))] += amount
                left = AHEAD_REACH if symbol == TARGET else max(0, left - 1)
        return total

    def probability(self, found: np.ndarray) -> np.ndarray:
        odds = self.bias + np.log1p(found) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _apply(model: Model, rows: DataFrame, carried: str) -> DataFrame:
    """``_id``, the carried column and the array ``_f`` of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.matches(t.as_py() or "") for t in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f.tolist() for f in found], pa.list_(pa.float64()))],
                ["_id", "_y", "_f"],
            )

    return rows.select("_id", "_y", "_t").mapInArrow(run, f"_id long, _y {carried}, _f array<double>")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    min_rows: int = 5,
    min_odds: float = 20.0,
    chance: float = 0.01,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learns from about ``max_rows`` labelled rows, drawn by a hash of the id (all if there are fewer).

    Words found in at least ``min_rows`` toxic rows and ``min_odds`` times as often as in the others join the
    insults if a likelihood-ratio test of independence refuses chance, at ``chance`` over all words tested;
    no share of all toxic rows is asked for, so rare words and small languages count. Seeds
    and learned words match in their regular inflected forms too. Then a logistic fit moves the feature weights away from the grammar's priors as far as the rows support. The priors
    are raised first so that one insult or directed threat is over ``THRESHOLD`` at the bias of the labels.
    Without both labels among the rows the priors stay.
    """
    truth = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    n = truth.count()
    parts = max(1, math.ceil(n / max_rows))
    drawn = F.pmod(F.xxhash64("_id"), F.lit(parts)) == 0
    picked = truth.select(F.col("doc_id").cast("long").alias("_id"), "_y").filter(drawn)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")).filter(drawn)
    # The draw runs on both sides of the join, so only about max_rows texts move; they are read three times.
    rows = durable(texts.join(picked, "_id"))
    counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    model = Model()
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    known = {*TARGETS, *NEGATIONS, *REPORTS, *THREATS, *"\"“”„«»"}
    if not toxic or not clean:
        return Model(insults=dict.fromkeys(inflected(model.insults) - known, 1.0))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                found = sorted(set(TOKEN.findall((batch.column(1)[at].as_py() or "").lower())))
                y = batch.column(0).slice(at, 1).take(pa.array(np.zeros(len(found), np.int64)))
                yield pa.record_batch([pa.array(found, pa.string()), y], ["word", "_y"])

    per_word = (
        rows.select(F.col("_y").cast("int").alias("_y"), "_t")
        .mapInArrow(words, "word string, _y int")
        .groupBy("word")
        .agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c"))
    )
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    # Twice the log-likelihood ratio of the counts against independence; exp(-half of it) bounds its chance.
    both = F.col("t") + F.col("c")
    share = F.lit(toxic / (toxic + clean))

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, 2 * n * F.log(n / expected)).otherwise(0.0)

    fits = part(F.col("t"), both * share) + part(F.col("c"), both * (1 - share))
    per_word = durable(per_word)
    words_tested = per_word.filter(F.col("t") >= min_rows).count()
    learned = per_word.filter(
        (F.col("t") >= min_rows) & (ratio >= min_odds) & (fits >= 2 * math.log(max(1, words_tested) / chance))
    ).collect()
    lexicon = {*model.insults, *(r["word"] for r in learned)} - known
    model = Model(insults=dict.fromkeys(sorted(inflected(lexicon) - known), 1.0))
    seen = _apply(model, rows.withColumn("_y", F.col("_y").cast("int")), "int").groupBy("_f", "_y").count().collect()
    x = np.log1p(np.array([r["_f"] for r in seen]))
    y = np.array([r["_y"] for r in seen], float)
    w = np.array([r["count"] for r in seen], float)
    prior = np.array(model.weights)
    model.weights, model.bias = _logistic(x, y, w, prior)
    for parts in DECISIVE:
        prior[parts[-1]] += max(0.0, _needed(model.bias) - prior[parts].sum())
    model.weights, model.bias = _logistic(x, y, w, prior)
    # The second fit moves the bias; a weight that no row bears on follows it.
    weights = np.array(model.weights)
    for parts in DECISIVE:
        if not x[:, parts[-1]].any():
            weights[parts[-1]] += max(0.0, _needed(model.bias) - weights[parts].sum())
    model.weights = weights.tolist()
    return model


def _needed(bias: float) -> float:
    """The weight that puts one match over ``THRESHOLD``, with a margin of 0.5 in log-odds."""
    return (math.log(THRESHOLD / (1 - THRESHOLD)) + 0.5 - bias) / math.log(2)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray) -> tuple[list[float], float]:
    """Newton steps, halved until the loss falls, for weighted logistic regression with a unit normal prior around ``prior``."""
    full = np.column_stack([x, np.ones(len(x))])
    centre = np.append(prior, 0.0)
    ridge = np.append(np.ones(len(prior)), 1e-6)
    beta = np.append(prior, math.log((w @ y + 0.5) / (w @ (1 - y) + 0.5)))

    def loss(b: np.ndarray) -> float:
        z = full @ b
        return float(w @ (np.logaddexp(0, z) - y * z) + ridge @ (b - centre) ** 2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (w * (y - p)) - ridge * (beta - centre)
        curvature = (full.T * (w * p * (1 - p) + 1e-9)) @ full + np.diag(ridge)
        move = np.linalg.solve(curvature, gradient)
        now = loss(beta)
        while loss(beta + move) > now and np.abs(move).max() >= 1e-8:
            move = move / 2
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1].tolist(), float(beta[-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, score, features`` for every row: the model's probability of label 1 for the whole text.

    Clauses end at ``. ! ? ; :`` and line ends. The composed transducer reads the words of each clause that
    holds a trigger: a negation cancels insults and threats within its reach, a report verb or
    quotes mark what follows as reported, a target before or after it marks it as directed. Null and
    empty texts match nothing and get the base probability. Rows may repeat, ids may be null, an
    empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.lit(0).alias("_y"), text_of(text_col).alias("_t"))
    weights = [float(w) for w in model.weights]
    odds = F.lit(float(model.bias))
    for i, w in enumerate(weights):
        odds = odds + F.log1p(F.col("_f")[i]) * F.lit(w)
    clipped = F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))
    return _apply(model, rows, "int").select(
        F.col("_id").alias(id_col), (1 / (1 + F.exp(-clipped))).alias("score"), F.col("_f").alias("features")
    )


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, held_out, score, predicted`` with a model learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out(id_col)), labels.filter(~held_out("doc_id")), id_col=id_col, text_col=text_col)
    return score(docs, model, id_col, text_col).select(
        id_col,
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
