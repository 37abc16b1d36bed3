"""Removal of byte strings that occur more than once, by suffix arrays over small groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..plans.skew import lookup
from .common import fixed_words, mix64, text_of, utf8_bytes

#: Length of a repeated string that is removed.
LENGTH = 200

#: Bytes of the hash that picks one anchor in every window.
GRAM = 32

#: Window starts handled at a time within a text.
CHUNK = 1 << 19

#: Offsets of a window to its anchor that share a group; the bytes common to them are the core.
CELL = 38

#: Distinct members above which a group is compared window by window through the shuffle instead.
GROUP = 4_000

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_BYTE = fixed_words(31, 256)
_NO_ID = -(2**63)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by grouping: no recursion, no renaming (a shorter suffix sorts before its extensions).

    Phase 1 keeps the suffixes in a list of groups of equal known prefix, at first the first symbol, and visits the
    groups from the largest down. Each member points to the nearest suffix before it in a smaller
    group; suffixes that are pointed to are longer by the visited prefix, once per pointer, so they leave
    their group for new ones right behind it. In the end the prefix of each group is the longest Lyndon
    prefix of its members. Phase 2 visits the suffixes in their final order, smallest first, and for each
    puts its left neighbour, and what that one points to, at the next free place of their groups.
    """
    n = len(text)
    if not n:
        return []
    order = sorted(set(text))
    name = {c: g for g, c in enumerate(order)}
    group = [name[c] for c in text]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    below = [g - 1 for g in range(len(order))]
    above = [*range(1, len(order)), -1]
    first = 0
    previous = [-1] * n
    visited = [False] * n
    at = len(order) - 1
    while at >= 0:
        times: dict[int, int] = {}
        for i in members[at]:
            j = i - 1
            while j >= 0 and visited[j]:
                j = previous[j]
            previous[i] = j
            visited[i] = True
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        touched: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            touched.setdefault(group[j], {}).setdefault(k, []).append(j)
        for g, by_count in touched.items():
            moved = sum(map(len, by_count.values()))
            behind = g
            counts = sorted(by_count)
            if moved == len(members[g]):
                # Nobody stays behind: the least extended keep the group.
                members[g] = sorted(by_count[counts.pop(0)])
            else:
                members[g] = [i for i in members[g] if i not in times]
            for k in counts:
                new = len(members)
                members.append(sorted(by_count[k]))
                for j in members[new]:
                    group[j] = new
                below.append(behind)
                above.append(above[behind])
                if above[behind] >= 0:
                    below[above[behind]] = new
                above[behind] = new
                behind = new
        at = below[at]
    free = [0] * len(members)
    place, g = 0, first
    while g >= 0:
        free[g] = place
        place += len(members[g])
        g = above[g]
    out = [-1] * n
    done = [False] * n

    def put(j: int) -> None:
        while j >= 0 and not done[j]:
            out[free[group[j]]] = j
            free[group[j]] += 1
            done[j] = True
            j = previous[j]

    put(n - 1)
    for r in range(n):
        put(out[r] - 1)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(20, (n - 1).bit_length())
    if (base, size) not in _POWERS:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _POWERS[base, size] = np.multiply.accumulate(steps)
    return _POWERS[base, size][:n]


class Hashes:
    """Hashes of any stretch of a byte array from its prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + size)


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every run of ``width`` keys."""
    n = len(keys)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    grid = full.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For one text: anchor, first and last window start that has it, hash of its gram and of all its windows' bytes.

    The anchor of a window of ``LENGTH`` bytes is its leftmost gram of least hash, so equal windows have theirs at the
    same offset wherever they stand.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        piece = data[at : at + CHUNK + LENGTH - 1]
        hashes = Hashes(piece)
        grams = np.arange(len(piece) - GRAM + 1)
        code = hashes.of(grams, grams + GRAM)
        least = _window_minima((code & ~low) | grams.astype(np.uint64), LENGTH - GRAM + 1)
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        spot = anchor[first]
        parts.append((spot + at, first + at, last + at, code[spot], hashes.of(first, last + LENGTH)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(rows: DataFrame) -> DataFrame:
    """``_id, a, lo, hi, gram, whole`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for i in range(len(batch)):
                if offsets[i + 1] - offsets[i] >= LENGTH:
                    found = anchors_of(data[offsets[i] : offsets[i + 1]])
                    held.append((np.full(len(found[0]), ids[i]), *found))
                    size += len(found[0])
                if held and (size >= 100_000 or i == len(batch) - 1):
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        columns[4:] = [c.view(np.int64) for c in columns[4:]]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["_id", "a", "lo", "hi", "gram", "whole"])

    return rows.mapInArrow(run, "_id long, a long, lo long, hi long, gram long, whole long")


def _parts(texts: DataFrame) -> DataFrame:
    """The cells of open anchors: ``core, part, _id, a, d1, d2, x, y`` of ``texts(_id, _t, spots)``.

    A cell holds the windows whose anchor is ``d`` bytes in, for ``CELL`` successive d. All of them contain the core;
    ``x`` and ``y`` are what they have before and behind it.
    """
    cells = [(c, min(c + CELL, LENGTH - GRAM + 1) - 1) for c in range(0, LENGTH - GRAM + 1, CELL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, spots in enumerate(batch.column(2).to_pylist()):
                body = data[offsets[i] : offsets[i + 1]]
                raw = body.tobytes()
                a = np.array([s["a"] for s in spots], np.int64)
                lo = np.array([s["lo"] for s in spots], np.int64)
                hi = np.array([s["hi"] for s in spots], np.int64)
                out: list[list] = [[] for _ in range(7)]
                for first, last in cells:
                    d1, d2 = np.maximum(a - hi, first), np.minimum(a - lo, last)
                    live = np.flatnonzero(d1 <= d2)
                    if not len(live):
                        continue
                    spot, d1, d2 = a[live], d1[live], d2[live]
                    begin, end = spot - first, spot - last + LENGTH
                    base = int((spot - d2).min())
                    top = int((spot - d1).max()) + LENGTH
                    hashes = Hashes(body[base:top])
                    core = mix64(hashes.of(begin - base, end - base) + np.uint64(first))
                    part = mix64(hashes.of(spot - d2 - base, spot - d1 + LENGTH - base) + d1.astype(np.uint64))
                    out[0].append(core.view(np.int64))
                    out[1].append(part.view(np.int64))
                    out[2].append(spot)
                    out[3].append(d1)
                    out[4].append(d2)
                    out[5] += [raw[s - q : b] for s, q, b in zip(spot, d2, begin, strict=True)]
                    out[6] += [raw[e : s - q + LENGTH] for s, q, e in zip(spot, d1, end, strict=True)]
                flat = [np.concatenate(c) for c in out[:5]]
                yield pa.record_batch(
                    [
                        *[pa.array(c) for c in flat[:2]],
                        pa.array([ids[i]] * len(flat[0]), pa.int64()),
                        *[pa.array(c) for c in flat[2:]],
                        pa.array(out[5], pa.binary()),
                        pa.array(out[6], pa.binary()),
                    ],
                    names,
                )

    schema = "core long, part long, _id long, a long, d1 long, d2 long, x binary, y binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return texts.select("_id", "_t", "spots").mapInArrow(run, schema)


def _repeated_windows(rows: list[tuple]) -> list[list[int]]:
    """For members ``(d1, d2, x, y)`` of one core: the d whose window another member has too.

    The core is one symbol, so a window is ``x[-k:] core y[:m]`` of one length for all d of the cell. The suffix array of
    the members, each followed by an end mark, puts equal windows next to each other.
    """
    width = max(len(x) + len(y) + 1 - (d2 - d1) for d1, d2, x, y in rows)
    text: list[int] = []
    starts: dict[int, tuple[int, int]] = {}
    for r, (d1, d2, x, y) in enumerate(rows):
        for d in range(d2, d1 - 1, -1):
            starts[len(text) + d2 - d] = (r, d)
        text += [b + 2 for b in x]
        text.append(1)
        text += [b + 2 for b in y]
        text.append(0)
    found: list[list[int]] = [[] for _ in rows]
    before: int | None = None
    counted = True
    for i in suffix_array(text):
        if i not in starts:
            continue
        if before is not None and text[i : i + width] == text[before : before + width]:
            r, d = starts[i]
            found[r].append(d)
            if not counted:
                r, d = starts[before]
                found[r].append(d)
            counted = True
        else:
            counted = False
        before = i
    return found


def _by_suffix_array(members: DataFrame) -> DataFrame:
    """``_id, lo, hi`` of repeated windows in groups whose rows stand together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            columns = [batch.column(c).to_pylist() for c in range(8)]
            for core, single, doc, a, d1, d2, x, y in zip(*columns, strict=True):
                if core != key:
                    out += solved(held)
                    key, held = core, []
                held.append((single, doc, a, d1, d2, x, y))
            yield spans(out)
        yield spans(solved(held))

    def solved(held: list[tuple]) -> list[tuple[int, int, int]]:
        if len(held) < 2:
            return []
        found = _repeated_windows([row[3:] for row in held])
        return [(doc, a - d, a - d) for (single, doc, a, *_), ds in zip(held, found, strict=True) if single for d in ds]

    def spans(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["_id", "lo", "hi"])

    columns = ["core", "single", "_id", "a", "d1", "d2", "x", "y"]
    placed = members.select(*columns).repartition("core").sortWithinPartitions("core")
    return placed.mapInArrow(run, "_id long, lo long, hi long")


def _by_window(members: DataFrame) -> DataFrame:
    """The same for groups of any size: one row per window, counted by its bytes around the core."""
    windows = members.withColumn("d", F.explode(F.sequence("d1", "d2"))).withColumn(
        "w",
        F.xxhash64(
            F.expr("substring(x, cast(d2 - d + 1 as int))"),
            F.expr("substring(y, 1, cast(octet_length(y) - (d - d1) as int))"),
            F.sha2(F.expr("concat(substring(x, cast(d2 - d + 1 as int)), substring(y, 1, cast(octet_length(y) - (d - d1) as int)))"), 256),
        ),
    )
    often = windows.groupBy("core", "d", "w").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    hits = lookup(windows, often, ["core", "d", "w"], "_n").filter("single")
    return hits.select("_id", (F.col("a") - F.col("d")).alias("lo"), (F.col("a") - F.col("d")).alias("hi"))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``_id, lo, hi``: runs of window starts of ``rows(_id, _t)`` whose ``LENGTH`` bytes also start elsewhere."""
    anchors = durable(_anchors(rows))
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = durable(lookup(anchors, grams, ["gram"], "_n"))
    wholes = shared.groupBy("gram", "whole").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "a", "lo", "hi")).alias("_one")
    )
    wholes = durable(wholes)
    copied = lookup(shared, wholes.filter("_n > 1").select("gram", "whole", "_n"), ["gram", "whole"], "_n")
    # One of each set of copies stands for all against the anchors that are unlike.
    unlike = wholes.groupBy("gram").agg(F.count(F.lit(1)).alias("_kinds"), F.count(F.lit(1)).alias("_w")).filter("_kinds > 1")
    spots = lookup(wholes, unlike.drop("_kinds"), ["gram"], "_w").select("_one.*", (F.col("_n") == 1).alias("single"))
    spots = durable(spots)
    per_text = durable(spots.groupBy("_id").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("spots")))
    parts = durable(_parts(rows.join(per_text, "_id")))
    cores = parts.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    parts = durable(lookup(parts, cores, ["core"], "_n"))
    kinds = parts.groupBy("core", "part").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "a", "d1", "d2", "x", "y")).alias("_one")
    )
    kinds = durable(kinds)
    same = lookup(parts, kinds.filter("_n > 1").select("core", "part", "_n"), ["core", "part"], "_n")
    sizes = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("_kinds"), F.count(F.lit(1)).alias("_w")).filter("_kinds > 1")
    open_ = lookup(kinds.select("core", (F.col("_n") == 1).alias("single"), "_one.*"), sizes, ["core"], "_w")
    open_ = durable(open_)
    small = _by_suffix_array(open_.filter(F.col("_kinds") <= GROUP))
    large = _by_window(open_.filter(F.col("_kinds") > GROUP))
    return (
        copied.select("_id", "lo", "hi")
        .unionByName(same.select("_id", (F.col("a") - F.col("d2")).alias("lo"), (F.col("a") - F.col("d1")).alias("hi")))
        .unionByName(small)
        .unionByName(large)
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, kept, n_bytes, n_removed, n_spans``: the bytes of every text without those in repeated strings.

    A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in the same or another
    text, judged on the input. ``kept`` is binary, since cuts may split a character.

    Every window of ``LENGTH`` bytes has an anchor that equal windows share. Windows of one anchor with
    equal bytes altogether are repeated; an anchor whose gram occurs once has none. What is left is cut into cells,
    grouped by the bytes its windows have in common, and each group's suffix array (``suffix_array``)
    shows which windows are equal. Groups of over ``GROUP`` different members are counted window by
    window instead. Only hashes, positions and the bytes around such cores are shuffled, and texts twice.
    Stretches are compared by 64-bit hashes of their bytes except in the groups, where bytes are.

    Null and empty texts have no bytes; texts shorter than ``LENGTH`` keep all. Ids must be unique; of rows
    with one id, or with null, each loses the positions of all of them. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), text_of(text_col).alias("_t"))
    found = repeated_windows(rows)
    per_text = durable(found.groupBy("_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_bytes(batch.column(1))
            kept, sizes, removed, spans = [], [], [], []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                body = data[offsets[i] : offsets[i + 1]]
                sizes.append(len(body))
                if not runs:
                    kept.append(body.tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                depth = np.zeros(len(body) + 1, np.int64)
                np.add.at(depth, np.minimum([r["lo"] for r in runs], len(body)), 1)
                np.add.at(depth, np.minimum([r["hi"] + LENGTH for r in runs], len(body)), -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept.append(body[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(kept, pa.binary()),
                    *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)],
                ],
                ["_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    joined = rows.join(per_text, "_id", "left").select("_id", "_t", "runs")
    out = joined.mapInArrow(run, "_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(F.when(F.col("_id") != _NO_ID, F.col("_id")).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans")
