"""Landed monthly files of one source, whose schemas drift from month to month."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from curbside.operators.conform import drift_union, tag_source
from curbside.spec import DEFAULT_SPEC, TripSpec

log = logging.getLogger(__name__)

_FOOTER_READERS = 8


class NoLandedFilesError(RuntimeError):
    """None of a source's expected monthly files has landed."""


class DriftError(TypeError):
    """Landed files have types of one column that cannot be united."""


@dataclass(frozen=True)
class LandingScan:
    """The scan of one source and which of its expected months it covers."""

    trips: DataFrame
    found: tuple[str, ...]
    paths: tuple[str, ...]
    missing: tuple[str, ...]


def landed_path(landing: str, source: str, month: str, spec: TripSpec = DEFAULT_SPEC) -> str:
    return f"{landing.rstrip('/')}/{spec.landing_name.format(source=source, month=month)}"


Group = tuple[T.StructType, list[str]]


def _together(spark: SparkSession, paths: list[str]) -> list[Group]:
    """Paths grouped so that the schemas inside a group merge. Spark reads the footers in
    tasks. Where they do not all merge, each half of the paths is tried for itself."""
    try:
        return [(spark.read.option("mergeSchema", "true").parquet(*paths).schema, paths)]
    except Py4JJavaError as error:  # Spark's own error class, which Python has no name for
        if len(paths) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    half = len(paths) // 2
    return [*_together(spark, paths[:half]), *_together(spark, paths[half:])]


def landed_schemas(spark: SparkSession, path: str) -> list[Group]:
    """Schemas of one month's part files and the paths that have them; none if the month has
    not landed. Part files that drifted apart are told apart by their footers."""
    try:
        return _together(spark, [path])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    except Py4JJavaError as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
        # Only the listing is read, no content.
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        parts = sorted(row[0] for row in files.select("path").collect())
        return _together(spark, parts)


_NUMBERS = (T.NumericType,)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _united(a: T.DataType, b: T.DataType) -> bool:
    """Whether a union of the two loses and invents nothing. Zoned and un-zoned times pass
    here; the union itself has an error of its own for them."""
    return (
        a == b
        or isinstance(a, T.NullType) or isinstance(b, T.NullType)
        or isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS)
        or isinstance(a, _TIMES) and isinstance(b, _TIMES)
        or _plain(a) == _plain(b)
    )


def _plain(kind: T.DataType) -> str:
    return "string" if isinstance(kind, (T.CharType, T.VarcharType)) else kind.simpleString()


def check_drift(groups: list[Group]) -> None:
    """`DriftError` for a column whose types cannot be united, with a file of each."""
    seen: dict[str, tuple[T.DataType, str]] = {}
    for schema, paths in groups:
        for column in schema:
            kind, where = seen.setdefault(column.name.lower(), (column.dataType, paths[0]))
            if not _united(kind, column.dataType):
                raise DriftError(
                    f"{column.name} is {kind.simpleString()} in {where} and "
                    f"{column.dataType.simpleString()} in {paths[0]}"
                )


def scan_landing(
    spark: SparkSession, landing: str, source: str, spec: TripSpec = DEFAULT_SPEC
) -> LandingScan:
    """All landed months of `source` as one tagged DataFrame.

    A missing month is logged and skipped; without any month there is nothing to
    scan and `NoLandedFilesError` is raised; any other read error is passed on. Numbers
    widen; text in a number's place (or the like) is a `DriftError` that names the column and
    a file of each type, before anything is read.

    Months are read with their own types and reconciled afterwards, so a column
    that is INT32 in one month and BIGINT in the next needs no special reader
    settings; so are part files of one month. Files with equal schemas share one multi-path
    scan: the plan has as many branches as there are schemas, not as many as there are files.
    """
    paths = {month: landed_path(landing, source, month, spec) for month in spec.landing_months}
    # Footer reads only, but each is a round trip to the store: overlap them.
    read_schemas = inheritable_thread_target(spark)(lambda path: landed_schemas(spark, path))
    with ThreadPoolExecutor(_FOOTER_READERS) as pool:
        landed = dict(zip(paths, pool.map(read_schemas, paths.values())))

    missing = tuple(month for month, found in landed.items() if not found)
    for month in missing:
        log.warning("no file for %s %s, skipped: %s", source, month, paths[month])

    every = [group for found in landed.values() for group in found]
    if not every:
        raise NoLandedFilesError(f"no landed files for {source} under {landing}")
    check_drift(every)
    groups: dict[str, Group] = {}
    for schema, members in every:
        groups.setdefault(schema.json(), (schema, []))[1].extend(members)

    scans = [spark.read.schema(schema).parquet(*members) for schema, members in groups.values()]
    trips = drift_union([tag_source(scan, source, spec) for scan in scans])
    found = tuple(month for month in paths if month not in missing)
    return LandingScan(trips, found, tuple(paths[month] for month in found), missing)
