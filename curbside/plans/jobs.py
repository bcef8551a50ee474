"""Layer-to-layer jobs. Each reads stored tables and writes stored tables, so a
failed run is resumed by running its layer again."""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyarrow import csv
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.functions import in_month
from curbside.operators import quality, reports
from curbside.operators.conform import conform, strict_union
from curbside.operators.marts import (
    MARTS,
    hourly_rollup,
    mart_order,
    mart_schema,
    rollup_basis,
)
from curbside.sources import (
    hand_over,
    is_stored,
    overwrite_table,
    own_session,
    preview,
    read_table,
    scan_landing,
    side_by_side,
)
from curbside.spec import DEFAULT_SPEC, TripSpec

log = logging.getLogger(__name__)

#: Second partition column of the cleaned table, as a whole number like 202305. Readers of
#: the table do not see it.
PICKUP_MONTH = "pickup_month"

#: About what a file of the cleaned table should hold.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Lake:
    """Where the layers live. `root` and `landing` are any URIs the session can
    reach; credentials and endpoints are the session's business."""

    root: str
    landing: str
    fmt: str = "parquet"
    spec: TripSpec = DEFAULT_SPEC

    def bronze(self, source: str) -> str:
        return f"{self.root.rstrip('/')}/bronze/{self.spec.table_name(source)}"

    @property
    def silver(self) -> str:
        return f"{self.root.rstrip('/')}/silver/all_taxi"

    @property
    def rollup(self) -> str:
        """The marts' common input, replaced by every run."""
        return f"{self.root.rstrip('/')}/gold/hourly_rollup"

    def gold(self, mart: str) -> str:
        return f"{self.root.rstrip('/')}/gold/{mart}"


class NoMartsError(RuntimeError):
    """Reports were asked for before any mart was stored."""


class BronzeError(RuntimeError):
    """Some sources failed; `run` holds what was written for the others."""

    def __init__(self, run: BronzeRun):
        super().__init__(f"sources that failed: {', '.join(run.failed)}")
        self.run = run


@dataclass
class BronzeRun:
    """Rows stored per source, months that had not landed, and failures."""

    rows: dict[str, int] = field(default_factory=dict)
    missing: dict[str, tuple[str, ...]] = field(default_factory=dict)
    failed: dict[str, Exception] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.rows.values())


def bronze_source(spark: SparkSession, lake: Lake, source: str) -> tuple[int, tuple[str, ...]]:
    """Store one source's landed months as its raw table.

    Returns the stored rows, counted as they were written, and the skipped months.
    """
    scan = scan_landing(spark, lake.landing, source, lake.spec)
    stored = Observation(f"raw {source}")
    rows = scan.trips.observe(stored, F.count("*").alias("rows"))
    overwrite_table(rows, lake.bronze(source), lake.fmt, inputs=scan.paths)
    return stored.get.get("rows", 0), scan.missing


def bronze_all(spark: SparkSession, lake: Lake) -> BronzeRun:
    """Every source, all at once, each in a session of its own. A failing source does not
    stop the others, but the run as a whole then fails with `BronzeError`."""
    run = BronzeRun()
    results = side_by_side(spark, {
        source: lambda source=source: bronze_source(own_session(spark), lake, source)
        for source in lake.spec.sources
    })
    for source, result in results.items():
        if isinstance(result, Exception):  # reported for the whole run below
            log.error("%s failed", source, exc_info=result)
            run.failed[source] = result
        else:
            run.rows[source], run.missing[source] = result
            log.info("%s: %d rows", source, run.rows[source])
    if run.failed:
        raise BronzeError(run)
    return run


def bronze_summary(spark: SparkSession, lake: Lake) -> DataFrame:
    """Stored rows per source and in total."""
    tags = [
        read_table(spark, lake.bronze(source), lake.fmt).select(lake.spec.source)
        for source in lake.spec.sources
    ]
    return quality.ingest_summary(strict_union(tags), lake.spec)


def conformed(spark: SparkSession, lake: Lake) -> DataFrame:
    """All raw tables under the common contract."""
    return strict_union([
        conform(read_table(spark, lake.bronze(source), lake.fmt), source, lake.spec)
        for source in lake.spec.sources
    ])


def _pickup_month(spec: TripSpec) -> Column:
    return F.year(spec.pickup) * 100 + F.month(spec.pickup)


def read_silver(spark: SparkSession, lake: Lake, month: int | None = None) -> DataFrame:
    """The cleaned table in contract order (its partition columns are stored last).

    With `month`, only the trips of this month of the year. Un-zoned times then prune by
    partition, as no row group of theirs can be skipped. Zoned ones belong to another
    month in another session zone, so they skip row groups by the range of `in_month`.
    """
    spec = lake.spec
    table = read_table(spark, lake.silver, lake.fmt)
    if month is not None:
        if isinstance(table.schema[spec.pickup].dataType, T.TimestampNTZType):
            table = table.filter(F.col(PICKUP_MONTH) % 100 == month)
        table = table.filter(in_month(spec, month))
    return table.select(*spec.contract)


def split_for(width: int, kept: int, file_bytes: int = FILE_BYTES) -> int:
    """Input per task for output files of about `file_bytes`, when of rows of `width`
    bytes `kept` are written on."""
    return file_bytes * max(width, kept) // kept


def _silver_split(spark: SparkSession, lake: Lake, file_bytes: int) -> int:
    # By the types' nominal widths; the widest source decides, its files being the smallest.
    def width(schema: T.StructType) -> int:
        sizes = {T.StringType: 20, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4}
        return sum(sizes.get(type(column.dataType), 8) for column in schema)

    stored = [read_table(spark, lake.bronze(s), lake.fmt).schema for s in lake.spec.sources]
    # The source is a partition's name, not a stored column.
    kept = width(lake.spec.contract_schema()) - 20
    return split_for(max(map(width, stored)), kept, file_bytes)


@dataclass(frozen=True)
class RuleCount:
    """Raw rows that break a rule, and those of them that break no other."""

    broken: int
    alone: int


@dataclass(frozen=True)
class SilverRun:
    """The fence used and the row counts around it, in all and by rule, plus two
    distributions of the stored table."""

    fence: float
    raw_rows: int
    clean_rows: int
    rules: dict[str, RuleCount]
    by_source: DataFrame
    by_month: DataFrame

    @property
    def removed_rows(self) -> int:
        return self.raw_rows - self.clean_rows

    @property
    def removed_pct(self) -> float | None:
        """One decimal, halves up, as in `quality.cleaning_report`."""
        if not self.raw_rows:
            return None
        return (2000 * self.removed_rows + self.raw_rows) // (2 * self.raw_rows) / 10


#: How rows of the cleaned table get to its files.
LAYOUTS = ("arrival", "rebalance")


def silver(
    spark: SparkSession,
    lake: Lake,
    layout: str = "arrival",
    months: Sequence[int] | None = None,
    fence: float | None = None,
    file_bytes: int = FILE_BYTES,
    **how,
) -> SilverRun:
    """Raw tables -> one cleaned table partitioned by source and month.

    Two passes over the data: the quartiles (two timestamp columns), then filter and
    write. Rows are counted in the write, rule by rule; no job does it afterwards.

    * ``arrival``: rows stay in the task that read them, so files keep the months they
      arrived in, and a task meets few partitions. A task reads as much as makes a file of
      about `file_bytes` of the columns that are kept. Right for files that landed by month.
    * ``rebalance``: one shuffle by source and month, in parts of about a file each however
      full a month is, ordered by pickup. For rows that arrive late or mixed, which would
      otherwise make a small file per task, source and month, with ranges that skip nothing.

    With `months` (as 202305), only those are replaced, from the raw trips of those months;
    they need the `fence` that the others were cleaned with. Otherwise a `fence` that is
    given is used as it is, and one that isn't is computed; `how` goes to it (`method`, `accuracy`).
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}: one of {', '.join(LAYOUTS)}")
    if months is not None and fence is None:
        raise ValueError("single months are cleaned with the fence of the others: give it")
    spec = lake.spec
    own = own_session(spark)
    raw = conformed(own, lake)
    if months is not None:
        raw = raw.filter(_pickup_month(spec).isin(list(months)))
    if fence is None:
        fence = quality.iqr_fence(raw, spec, **how)
    log.info("duration fence: %.4f h (%.1f min)", fence, fence * 60)
    counts = Observation("cleaned")
    seen = raw.observe(counts, *quality.rule_counts(fence, spec))
    rows = quality.clean(seen, fence, spec).withColumn(PICKUP_MONTH, _pickup_month(spec))
    parts = [spec.source, PICKUP_MONTH]
    if layout == "rebalance":
        rows = rows.hint("rebalance", *parts).sortWithinPartitions(*parts, spec.pickup)
    overwrite_table(
        rows,
        lake.silver,
        lake.fmt,
        partition_by=parts,
        inputs=[lake.bronze(source) for source in spec.sources],
        open_partitions=len(spec.sources) * max(len(spec.landing_months), 1),
        split_bytes=_silver_split(own, lake, file_bytes) if layout == "arrival" else None,
        # A shuffled row is about twice as wide as a stored one.
        shuffled_bytes=2 * file_bytes if layout == "rebalance" else None,
        partitions_only=months is not None,
    )
    stored = read_silver(spark, lake)
    found = counts.get
    run = SilverRun(
        fence=fence,
        raw_rows=found.get("raw_rows", 0),
        clean_rows=found.get("clean_rows", 0),
        rules={
            rule: RuleCount(found.get(f"{rule}_broken", 0), found.get(f"{rule}_alone", 0))
            for rule in quality.rules(fence, spec)
        },
        by_source=quality.trips_by_source(stored, spec),
        by_month=quality.trips_by_month(stored, spec),
    )
    log.info(
        "raw %d, clean %d, removed %d (%s %%); broken rules: %s",
        run.raw_rows, run.clean_rows, run.removed_rows, run.removed_pct,
        ", ".join(f"{rule} {n.broken} ({n.alone} alone)" for rule, n in run.rules.items()),
    )
    return run


def read_mart(spark: SparkSession, lake: Lake, name: str) -> DataFrame:
    """A stored mart in its order; typed and empty if it was never written.

    A mart has at most 24 rows per source, so it is read as one partition, and
    ordering or regrouping it needs no shuffle.
    """
    table = read_table(spark, lake.gold(name), lake.fmt, mart_schema(name, lake.spec))
    return table.coalesce(1).orderBy(*mart_order(name, lake.spec))


def _store_rollup(spark: SparkSession, lake: Lake, months: Sequence[int] | None) -> None:
    spec = lake.spec
    trips = read_table(spark, lake.silver, lake.fmt)
    if months is not None:
        trips = trips.filter(F.col(PICKUP_MONTH).isin(list(months)))
    rows = hourly_rollup(trips, spec, PICKUP_MONTH)
    if months is not None:
        # A month without trips any more is replaced by a row of none.
        every = F.array(*(F.lit(m) for m in months))
        for source in spec.sources:
            none = spark.range(1).select(
                F.lit(source).alias(spec.source), F.explode(every).alias(PICKUP_MONTH),
                F.lit(0).cast("bigint").alias("trips"),
            )
            rows = rows.unionByName(none, allowMissingColumns=True)
    overwrite_table(
        rows, lake.rollup, lake.fmt, partition_by=[spec.source, PICKUP_MONTH],
        inputs=[lake.silver], partitions_only=months is not None,
    )


def read_rollup(spark: SparkSession, lake: Lake) -> DataFrame:
    """The stored rollup as one partition: at most 24 rows per source and month."""
    return read_table(spark, lake.rollup, lake.fmt).filter("trips > 0").coalesce(1)


def gold(
    spark: SparkSession, lake: Lake, show: bool = False, months: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """Cleaned table -> the four marts, scanning the trips once.

    The hourly rollup is stored first, by source and month; the marts are derived from its
    few hundred rows, all at once. With `months` (as 202305), only those are scanned and
    replaced in a rollup that an earlier run stored. Previews read the stored marts.
    """
    _store_rollup(spark, lake, months)
    rollup = read_rollup(spark, lake)

    def store(name: str) -> None:
        result = MARTS[name](rollup, lake.spec, rollup_basis())
        overwrite_table(result, lake.gold(name), lake.fmt, inputs=[lake.silver])
        log.info("stored %s", lake.gold(name))

    for error in side_by_side(spark, {n: lambda n=n: store(n) for n in MARTS}).values():
        if error is not None:
            raise error
    written = {name: read_mart(spark, lake, name) for name in MARTS}
    if show:
        for mart in written.values():
            preview(mart).show(truncate=False)
    return written


#: The report sets that are not marts.
REPORTS = ("month_table", "hour_table", "type_table", "kpis", "side_by_side", "hour_facets")


def write_reports(sets: dict[str, DataFrame], folder: str, most: int = 100_000) -> list[str]:
    """Each report set as a CSV file in a folder of the driver's machine. One of more than
    `most` rows is an error, raised before any file is written."""
    tables = {name: hand_over(sets[name], most) for name in REPORTS}
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, table in tables.items():
        paths.append(os.path.join(folder, f"{name}.csv"))
        csv.write_csv(table, paths[-1])
    return paths


def report(spark: SparkSession, lake: Lake) -> dict[str, DataFrame]:
    """Every report set, over the stored marts. One that was not stored counts as empty;
    `NoMartsError` if none was."""
    spec = lake.spec
    if not any(is_stored(spark, lake.gold(name), lake.fmt) for name in MARTS):
        raise NoMartsError(f"no mart below {lake.root}: run the gold job first")
    marts = {name: read_mart(spark, lake, name) for name in MARTS}
    by_type, peaks = marts["trips_by_taxi_type"], marts["top_hours_by_taxi_type"]
    return {
        **marts,
        "month_table": reports.month_table(marts["avg_total_by_month"]),
        "hour_table": reports.hour_table(marts["avg_passengers_by_hour"]),
        "type_table": reports.type_table(by_type, spec),
        "kpis": reports.kpis(by_type, spec),
        "side_by_side": reports.side_by_side(by_type, spec),
        "hour_facets": reports.hour_facets(peaks, spec),
    }


@dataclass(frozen=True)
class LakeRun:
    """What each layer of a whole run reports, and the stored marts."""

    bronze: BronzeRun
    silver: SilverRun
    marts: dict[str, DataFrame]


def run_all(spark: SparkSession, lake: Lake, show: bool = False) -> LakeRun:
    """Raw layer, cleaned layer and marts in dependency order."""
    return LakeRun(bronze_all(spark, lake), silver(spark, lake), gold(spark, lake, show))
