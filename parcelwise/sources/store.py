"""Reuse of expensive intermediate frames (raw fixture, clean table, scored table).

``frame(spark, sf_dir, name, build)`` keeps one table per (application, state of the
input folder, name): written once as Parquet into the shared checkpoint folder and scanned afterwards.

``materialize(spark, df, name)`` writes a frame as Parquet under the session's shared
checkpoint folder and reads it back: the hand-off table between stages (and the way to
cut a long lineage) that every executor can read.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from parcelwise.sources.scratch import Scratch, delete_path

_FRAMES: dict[tuple[str, ...], DataFrame] = {}
_LOCKS: dict[tuple[str, ...], threading.Lock] = {}
_GUARD = threading.Lock()


#: Rows that one shuffle partition is meant for.
PARTITION_ROWS = 250_000
_PARTITIONS = "spark.sql.shuffle.partitions"
#: The setting as the session has it, and what the builds that run now need.
_RAISED: list[int] = []
_USUAL: list[int] = []


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles planned inside have at least one partition for every ``PARTITION_ROWS`` rows, so that
    a task's sorts fit its memory however large the table is; adaptive execution joins small ones."""
    needed = -(-rows // PARTITION_ROWS)
    with _GUARD:
        if not _RAISED:
            _USUAL[:] = [int(spark.conf.get(_PARTITIONS))]
        _RAISED.append(needed)
        spark.conf.set(_PARTITIONS, str(max(_USUAL + _RAISED)))
    try:
        yield
    finally:
        with _GUARD:
            _RAISED.remove(needed)
            spark.conf.set(_PARTITIONS, str(max(_USUAL + _RAISED)))


def _stamp(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of the files in ``folder``: a changed folder is
    another input."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, todo = [], [path]
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()


def input_key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str, str]:
    folder = sf_dir.rstrip("/")
    return (spark.sparkContext.applicationId, folder, _stamp(spark, folder), name)


def frame(spark: SparkSession, sf_dir: str, name: str,
          build: Callable[[], DataFrame], mode: str = "table", rows: Callable[[], int] | None = None) -> DataFrame:
    """The frame ``name`` for this application and input folder, built once.

    ``mode="table"`` (default) writes it as Parquet under the shared checkpoint folder
    and returns a scan of that table: lineage is cut, a lost executor re-reads files
    instead of recomputing the build, and later queries get column pruning and filter
    pushdown. ``rows`` is the number of rows that it is built from (``partitions_for``). ``mode="persist"`` keeps it in executor memory/disk instead.
    """
    key = input_key(spark, sf_dir, name)
    with _GUARD:
        lock = _LOCKS.setdefault(key, threading.Lock())
    with lock:  # one build per key even when queries are called from several threads
        if key not in _FRAMES:
            with partitions_for(spark, rows()) if rows else nullcontext():
                _FRAMES[key] = _built(spark, name, build, mode)
        return _FRAMES[key]


def _built(spark, name, build, mode) -> DataFrame:
    built = build()
    if mode == "table":
        return materialize(spark, built, name)
    return built.persist(StorageLevel.MEMORY_AND_DISK)


def forget(spark: SparkSession | None = None) -> None:
    """Let go of every frame kept for this application (all applications if None): persisted
    ones are released, tables deleted."""
    app = spark.sparkContext.applicationId if spark is not None else None
    for key in list(_FRAMES):
        if app is None or key[0] == app:
            df = _FRAMES.pop(key)
            path = getattr(df, "scratch_path", None)
            if path is None:
                df.unpersist()
            elif spark is not None:
                delete_path(spark, path)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of its own in the shared folder and read it back. A
    second table of the same name never touches the first."""
    return Scratch(spark, name).table(df, "table")
