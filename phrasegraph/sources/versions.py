"""Versioned tables: a manifest entry, written last, makes a folder visible.

Data go to a fresh folder first; only then a small entry under ``<root>/_manifest`` names it. A reader
looks at entries alone, so it never sees a folder that is being written, and what a lost job
left behind is never read. An entry that cannot be parsed was cut off while it was written and does not count.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "_manifest"
_VERSION = "version-"


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def entries(spark: SparkSession, root: str, prefix: str = "") -> dict[str, dict]:
    """All valid entries whose name starts with ``prefix``, by name in order."""
    fs, folder = _files(spark, f"{root}/{_MANIFEST}")
    if not fs.exists(folder):
        return {}
    names = sorted(status.getPath().getName() for status in fs.listStatus(folder))
    found = {name: read_entry(spark, root, name) for name in names if name.startswith(prefix)}
    return {name: info for name, info in found.items() if info is not None}


def read_entry(spark: SparkSession, root: str, name: str) -> dict | None:
    """One entry; None if it does not exist or is cut off."""
    fs, path = _files(spark, f"{root}/{_MANIFEST}/{name}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        info = json.loads(text)
    except ValueError:
        return None
    return info if isinstance(info, dict) and "folder" in info else None


def _write_entry(spark: SparkSession, root: str, name: str, info: dict, overwrite: bool) -> bool:
    """Write an entry; False if it exists and must not be replaced."""
    fs, path = _files(spark, f"{root}/{_MANIFEST}/{name}")
    try:
        stream = fs.create(path, overwrite)
    except Py4JJavaError:
        if not overwrite and fs.exists(path):
            return False
        raise
    stream.write(bytearray(json.dumps(info, sort_keys=True).encode()))
    stream.close()
    return True


def fresh_folder(root: str) -> str:
    """A folder below ``root`` that nothing has used."""
    return f"{root}/data-{uuid.uuid4().hex}"


def write_once(df: DataFrame, root: str, name: str, **info: object) -> bool:
    """Write ``df`` as the part ``name``; nothing happens if that part is already there.

    For steps that may run again after a failure. One writer per name.
    """
    spark = df.sparkSession
    if read_entry(spark, root, name) is not None:
        return False
    folder = fresh_folder(root)
    df.write.parquet(folder)
    return _write_entry(spark, root, name, {"folder": folder, **info}, overwrite=True)


def announce(spark: SparkSession, root: str, folder: str, **info: object) -> int:
    """Make a written folder the current version and return its number; of two writers the later number wins."""
    number = max((int(n[len(_VERSION) :]) for n in _taken(spark, root)), default=0)
    while True:
        number += 1
        if _write_entry(spark, root, f"{_VERSION}{number:012d}", {"folder": folder, **info}, overwrite=False):
            return number


def _taken(spark: SparkSession, root: str) -> list[str]:
    fs, folder = _files(spark, f"{root}/{_MANIFEST}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return [n for n in names if n.startswith(_VERSION)]


def publish(df: DataFrame, root: str, **info: object) -> int:
    """Write ``df`` as Parquet and make it the current version."""
    folder = fresh_folder(root)
    df.write.parquet(folder)
    return announce(df.sparkSession, root, folder, **info)


def current(spark: SparkSession, root: str) -> dict | None:
    """Entry of the newest version; None before the first."""
    for name in sorted(_taken(spark, root), reverse=True):
        info = read_entry(spark, root, name)
        if info is not None:
            return info
    return None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    info = current(spark, root)
    if info is None:
        raise ValueError(f"no version under {root}")
    return spark.read.parquet(info["folder"])
