"""Whole-table overwrites."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_SPLIT = "spark.sql.files.maxPartitionBytes"
_TIMESTAMPS = "spark.sql.parquet.outputTimestampType"
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

T = TypeVar("T")


def _normal(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return path.rstrip("/") + "/"


def reject_overlap(output: str, inputs: Iterable[str]) -> None:
    """Refuse to overwrite a folder that the same job still reads."""
    target = _normal(output)
    for path in map(_normal, inputs):
        if target.startswith(path) or path.startswith(target):
            raise ValueError(f"cannot overwrite {output} while reading {path.rstrip('/')}")


class _Writers:
    """Who writes in a session at the moment, and with which settings."""

    def __init__(self) -> None:
        self.free = threading.Condition()
        self.settings: dict[str, str] = {}
        self.before: dict[str, str | None] = {}
        self.active = 0


_WRITERS: dict[str, _Writers] = {}
_WRITERS_LOCK = threading.Lock()


@contextmanager
def _settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the duration of one write. Writes of several threads that want
    the same go on side by side, others wait for them; the last one puts back what was there
    before (what was not set is unset again). Other sessions have settings of their own."""
    session = spark._jsparkSession.sessionUUID()
    with _WRITERS_LOCK:
        writers = _WRITERS.setdefault(session, _Writers())
    with writers.free:
        writers.free.wait_for(lambda: not writers.active or writers.settings == settings)
        if not writers.active:
            writers.settings = dict(settings)
            explicit = spark.conf.getAll
            writers.before = {key: explicit.get(key) for key in settings}
            for key, value in settings.items():
                spark.conf.set(key, value)
        writers.active += 1
    try:
        yield
    finally:
        with writers.free:
            writers.active -= 1
            if not writers.active:
                for key, value in writers.before.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)
                writers.free.notify_all()


def own_session(spark: SparkSession) -> SparkSession:
    """A session for one job, with the caller's settings: what the job sets there concerns
    nobody else. Tables in it are addressed by path; temporary views stay with the caller."""
    own = spark.newSession()
    theirs = own.conf.getAll
    for key, value in spark.conf.getAll.items():
        if theirs.get(key) != value and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def side_by_side(spark: SparkSession, jobs: Mapping[str, Callable[[], T]]) -> dict[str, T | Exception]:
    """What each of several jobs gives, or the error it ends with. All run at once, each in a
    scheduler pool of its own name (of use where the cluster schedules fairly)."""

    def run(name: str, job: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return job()

    target = inheritable_thread_target(spark)(run)
    with ThreadPoolExecutor(max(len(jobs), 1)) as pool:
        running = {name: pool.submit(target, name, job) for name, job in jobs.items()}
    return {name: f.exception() or f.result() for name, f in running.items()}


def overwrite_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    inputs: Iterable[str] = (),
    open_partitions: int = 0,
    split_bytes: int | None = None,
    shuffled_bytes: int | None = None,
    partitions_only: bool = False,
) -> None:
    """Replace the table at `path` with `df`.

    Rows are written by the tasks that produced them; nothing is shuffled to
    lay out partitions. A task keeps up to `open_partitions` partition files open at
    once and only sorts its rows by partition if it meets more (with 0 it always
    sorts). Zoned timestamps are stored as 64-bit microseconds, which have the
    statistics that range filters prune by; Spark's default INT96 has none. `split_bytes` is
    how much of the files it reads a task gets at most, `shuffled_bytes` how much of what it
    shuffles (the session's settings, if not given). `inputs` are the paths `df` reads,
    checked before the old table is touched. The overwrite is of the whole table, also in a
    session set to replace only the partitions it touches; with `partitions_only` it replaces
    just the partitions that `df` has rows of. It is as atomic as the table format makes
    it: plain Parquet is not.
    """
    reject_overlap(path, inputs)
    mode = "dynamic" if partitions_only else "static"
    writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark = df.sparkSession
    open_files = max(open_partitions, int(spark.conf.get(_OPEN_FILES)))
    settings = {_OPEN_FILES: str(open_files), _TIMESTAMPS: "TIMESTAMP_MICROS"}
    if split_bytes is not None:
        settings[_SPLIT] = str(split_bytes)
    if shuffled_bytes is not None:
        settings[_ADVISORY] = str(shuffled_bytes)
    with _settings(spark, settings):
        writer.save(path)
