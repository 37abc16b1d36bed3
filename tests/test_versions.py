"""Versioned tables and compaction of flag batches."""

import pytest

from phrasegraph.sources import versions as V
from phrasegraph.streaming import labels as L


def _entry(root, name, text):
    folder = root / "_manifest"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_readers_see_announced_versions_only(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(ValueError):
        V.read_current(spark, root)
    assert V.publish(spark.range(3).toDF("x"), root) == 1
    assert V.publish(spark.range(5).toDF("x"), root, note="five") == 2
    # A folder without an entry and an entry cut off while it was written.
    spark.range(9).toDF("x").write.parquet(V.fresh_folder(root))
    _entry(tmp_path / "table", "version-000000000003", '{"folder": "')
    assert V.read_current(spark, root).count() == 5
    assert V.current(spark, root)["note"] == "five"
    assert V.publish(spark.range(7).toDF("x"), root) == 4
    assert V.read_current(spark, root).count() == 7


def test_a_part_is_written_once(spark, tmp_path):
    root = str(tmp_path / "parts")
    assert V.write_once(spark.range(2).toDF("x"), root, "batch-1", batch=1)
    assert not V.write_once(spark.range(4).toDF("x"), root, "batch-1", batch=1)
    _entry(tmp_path / "parts", "batch-2", "")
    assert V.write_once(spark.range(6).toDF("x"), root, "batch-2", batch=2)
    sizes = [spark.read.parquet(e["folder"]).count() for e in V.entries(spark, root, "batch-").values()]
    assert sizes == [2, 6]


def test_flags_are_the_same_before_and_after_compaction(spark, tmp_path):
    columns = "row_no long, `keyword 1` string, `keyword 2` string, " + ", ".join(
        f"`{f} {s}` boolean" for f in ("omit", "method", "thematic") for s in (1, 2)
    )
    sheets, root, place = str(tmp_path / "sheets"), str(tmp_path / "flags"), str(tmp_path / "place")

    def submit(*rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(sheets)
        stream = L.submissions(spark, sheets, spark.read.parquet(sheets).schema)
        L.stream_flags(stream, "row_no", root, place).awaitTermination()

    phrases = spark.createDataFrame(
        [("a", False, None, True), ("b", False, None, True), ("c", None, None, None)],
        "phrase string, omit boolean, method boolean, thematic boolean",
    )

    def flags():
        return {r["phrase"]: tuple(r)[1:] for r in L.current_flags(spark, phrases, root).collect()}

    assert L.compact_flags(spark, root) is None
    assert flags() == {"a": (False, None, True), "b": (False, None, True), "c": (None, None, None)}
    submit((1, "a", "b", True, None, None, True, None, None), (2, "b", None, None, True, None, None, False, None))
    first = flags()
    assert first == {"a": (True, None, True), "b": (False, True, False), "c": (None, None, None)}
    assert L.compact_flags(spark, root) == 1
    assert flags() == first
    submit((3, "a", "c", False, True, None, None, None, None))
    assert flags() == {"a": (False, None, True), "b": (False, True, False), "c": (True, None, None)}
    # A batch that the compacted version holds, written anew after a crash, changes nothing.
    (name,) = [n for n in V.entries(spark, root, "batch-") if n.endswith("-000000000000")]
    assert not V.write_once(spark.range(1).toDF("phrase"), root, name)
    assert L.compact_flags(spark, root) == 2
    assert flags() == {"a": (False, None, True), "b": (False, True, False), "c": (True, None, None)}
