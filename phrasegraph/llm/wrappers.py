"""Main text of web pages by wrappers: union-free regular expressions inferred for each host."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, steps
from .common import slices, text_of
from .pagetree import Node, dumps, judge, loads, merged, parse, placed, pruned
from .urls import host_of

#: Wrappers of one host that a task merges in one go.
FAN_IN = 16

#: Items that a wrapper keeps at most; the optional ones with least text go first. A page's slots that are
#: in no wrapper are judged from the page alone, so this bounds memory and drops no text.
MOST_ITEMS = 2_000

#: Hosts whose wrappers a task holds before it passes them on.
MOST_HOSTS = 2_000

#: Shapes of pages whose verdicts a task remembers.
MOST_SHAPES = 20_000


def _joined(known: Node | None, new: Node) -> Node:
    return new if known is None else pruned(merged(known, new), MOST_ITEMS)


def _partial(pages: DataFrame) -> DataFrame:
    """``host, pages, wrapper``: per task and host one wrapper, aligned page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, list]] = {}

        def out() -> pa.RecordBatch:
            rows = []
            for host, shapes in held.items():
                whole, n = None, 0
                for root, seen in shapes.values():
                    whole, n = _joined(whole, root), n + seen
                rows.append((host, n, dumps(whole)))
            held.clear()
            return pa.record_batch([pa.array(c) for c in zip(*rows)], ["host", "pages", "wrapper"])

        shapes_held = 0
        for batch in slices(batches, 1):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root, _ = parse(page)
                for slot in root.slots():
                    slot.texts = []
                shapes = held.setdefault(host, {})
                if root.sign in shapes:
                    # An equal shape: only the counts of its slots grow.
                    shapes[root.sign][0] = merged(shapes[root.sign][0], root)
                    shapes[root.sign][1] += 1
                else:
                    shapes[root.sign] = [root, 1]
                    shapes_held += 1
                if shapes_held >= MOST_HOSTS:
                    yield out()
                    shapes_held = 0
        if held:
            yield out()

    return pages.select("host", "html").mapInArrow(run, "host string, pages long, wrapper string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, pages, wrapper`` from ``host, html``: one expression that covers all pages of a host.

    Each task aligns its own pages host by host; then wrappers of a host are aligned with each other, at
    most about ``FAN_IN`` in one group, in rounds until one is left. So a host with any share of the pages is
    spread over many tasks, and a group's size does not grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, n = None, None, 0
        names = ["host", "pages", "wrapper"]
        for batch in batches:
            for host, group, count, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (host, group) != key:
                    if key is not None:
                        yield pa.record_batch([[key[0]], [n], [dumps(whole)]], names)
                    key, whole, n = (host, group), None, 0
                whole, n = _joined(whole, loads(text)), n + count
        if key is not None:
            yield pa.record_batch([[key[0]], [n], [dumps(whole)]], names)

    found = durable(_partial(pages))
    while True:
        counts = found.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n")).first()[0]
        if most is None or most == 1:
            return found
        numbered = found.withColumn("_i", F.monotonically_increasing_id()).join(counts, "host")
        group = F.pmod(F.xxhash64("_i"), F.ceil(F.col("_n") / FAN_IN))
        grouped = numbered.select("host", group.alias("_g"), "pages", "wrapper")
        grouped = grouped.repartition("host", "_g").sortWithinPartitions("host", "_g")
        found = durable(grouped.mapInArrow(run, "host string, pages long, wrapper string"))


def _judged(wrappers: DataFrame) -> DataFrame:
    """``host, wrapper`` with the article's slots marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [dumps(judge(loads(text))) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(marked, pa.string())], ["host", "wrapper"])

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row: the article of the whole html, a block a line.

    Pages become streams of nested tags and text slots (``pagetree.parse``). Per host these are aligned one after
    another: neighbouring repeats fold into repeated groups, a mismatch becomes an optional item, and differing
    texts a slot; the result covers all pages of the host. In the wrapper, with the text mass
    of all its pages, the region of the article is chosen and parts that are no article are left out
    (``pagetree.judge``). Each page is then aligned with its host's wrapper, which says which of its slots count.

    A null html counts as empty and gives an empty text; a null url or one without ``://`` belongs to the
    host with an empty name. Null and repeated ids are rows of their own. An empty table gives no rows; other columns are
    ignored. Text that belongs to no wrapper is judged from its page alone; elements nested over
    ``pagetree.DEPTH`` deep only break lines. Pages are read whole; a task holds 4 MB of them, or one page.

    Html is read twice and moves only if the wrappers are too large for Spark to broadcast.
    """
    with steps(pages.sparkSession) as scope:
        read = pages.select(
            F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), text_of(html_col).alias("html")
        )
        wrappers = scope.keep(_judged(infer_wrappers(read)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Node] = {}
        verdicts: dict[bytes, list[bool]] = {}
        for batch in slices(batches, 2):
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                root, found = parse(page)
                shape = blake2b(f"{wrapper}\n{root.sign}".encode(), digest_size=16).digest()
                if shape not in verdicts:
                    if len(verdicts) >= MOST_SHAPES:
                        verdicts.clear()
                        loaded.clear()
                    if wrapper not in loaded:
                        loaded[wrapper] = loads(wrapper)
                    placed(judge(root), loaded[wrapper])
                    verdicts[shape] = [s.main for s in root.slots()]
                picked = [i for s, main in zip(root.slots(), verdicts[shape]) if main for i in s.texts]
                texts.append("\n".join(found[i] for i in sorted(picked)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = read.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    schema = read.select("page_id", "url").schema.add("text", "string")
    return kept.mapInArrow(run, schema)
