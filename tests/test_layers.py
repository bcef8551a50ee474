"""Counts inside the write, layouts, months alone, sources at once, drift, hand-over."""

import threading
import time
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import frame, trip

from curbside.__main__ import main
from curbside.operators import quality
from curbside.plans import jobs
from curbside.sources import (
    DriftError,
    TooManyRowsError,
    hand_over,
    overwrite_table,
    own_session,
    scan_landing,
    side_by_side,
    sinks,
)
from curbside.spec import DEFAULT_SPEC
from curbside.testbed import EVENTS, land_events

SPLIT = "spark.sql.files.maxPartitionBytes"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _trips(days=20, per_day=40, months=(1, 2, 3, 4, 5), source="yellow"):
    """Trips that get longer with the day, some of them bad in one or two ways."""
    out = []
    for month in months:
        for day in range(1, days + 1):
            for i in range(per_day):
                out.append(trip(
                    vendor=i, source=source, minutes=5 + (day * 7 + i) % 50,
                    pickup=datetime(2023, month, day, i % 24, i),
                    passengers=0.0 if i % 11 == 0 else 1.0, amount=-1.0 if i % 7 == 0 else 9.0 + i,
                ))
    return out


@pytest.fixture
def lake(spark, tmp_path):
    lake = jobs.Lake(root=str(tmp_path / "lake"), landing="")
    for source in DEFAULT_SPEC.sources:
        rows = frame(spark, _trips(source=source), timestamp=T.TimestampType())
        rows.repartition(4).write.parquet(lake.bronze(source))
    return lake


# ------------------------------------------------------------------ counts in the write


def test_rule_counts(spark):
    good = trip()
    rows = [good, good, trip(passengers=0.0), trip(passengers=None, amount=-1.0),
            trip(amount=None), trip(minutes=-5), trip(dropoff=None), trip(minutes=600),
            trip(pickup=datetime(2022, 1, 1), amount=20_000.0)]
    report = {r.rule: (r.broken_rows, r.alone_rows)
              for r in quality.rule_report(frame(spark, rows), 1.0).collect()}
    assert report == {
        "period": (1, 0), "passengers": (2, 1), "amount": (3, 1), "times": (1, 0),
        "direction": (2, 1), "duration": (2, 1),
    }
    assert list(report) == list(quality.rules(1.0))


def test_counts_come_from_the_writes(spark, sf_check, tmp_path, monkeypatch):
    lake = jobs.Lake(root=str(tmp_path), landing=land_events(spark, sf_check), spec=EVENTS)

    def no_job(self):
        raise AssertionError("a count after the write")

    monkeypatch.setattr(DataFrame, "count", no_job)
    raw = jobs.bronze_all(spark, lake)
    run = jobs.silver(spark, lake)
    monkeypatch.undo()
    conformed = jobs.conformed(spark, lake)
    assert raw.total == run.raw_rows == conformed.count() == 10_000
    assert run.clean_rows == jobs.read_silver(spark, lake).count() == 5328
    report = quality.rule_report(conformed, run.fence, EVENTS).collect()
    assert run.rules == {
        r.rule: jobs.RuleCount(r.broken_rows, r.alone_rows) for r in report
    }
    total = quality.cleaning_report(conformed, run.fence, EVENTS).first()
    assert (run.raw_rows, run.clean_rows, run.removed_rows, run.removed_pct) == tuple(total)


def test_nothing_written_is_counted_as_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    none = frame(spark, []).drop("taxi_type")
    none.write.parquet(f"{landing}/yellow_tripdata_2023-02.parquet")
    lake = jobs.Lake(root=str(tmp_path), landing=str(landing))
    assert jobs.bronze_source(spark, lake, "yellow")[0] == 0


# ------------------------------------------------------------------ layout


def _skipped_and_read(path, month):
    """Row groups whose pickup range lies outside the month, and the others."""
    ranges = []
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {group.column(c).path_in_schema: group.column(c).statistics
                     for c in range(group.num_columns)}["tpep_pickup_datetime"]
            ranges.append((stats.min, stats.max))
    away = sum(hi.month < month or lo.month > month for lo, hi in ranges)
    return away, len(ranges) - away


@pytest.mark.parametrize("layout", jobs.LAYOUTS)
def test_layouts_of_mixed_arrivals(spark, lake, layout):
    """160 mixed input files. By arrival that makes many small files; balanced, one for each
    source and month, ordered by pickup."""
    for source in DEFAULT_SPEC.sources:
        rows = spark.read.parquet(lake.bronze(source)).collect()
        mixed = frame(spark, rows, timestamp=T.TimestampType()).repartition(80, F.rand(3))
        mixed.write.mode("overwrite").parquet(lake.bronze(source))
    want = quality.clean(jobs.conformed(spark, lake), quality.iqr_fence(jobs.conformed(spark, lake)))
    run = jobs.silver(spark, lake, layout=layout, file_bytes=20_000 if layout == "arrival" else 1 << 20)
    assert run.clean_rows == want.count()
    assert _rows(jobs.read_silver(spark, lake)) == _rows(want)
    files = list(Path(lake.silver).rglob("*.parquet"))
    parts = {f.parent for f in files}
    assert len(parts) == 10
    if layout == "arrival":
        assert len(files) > 3 * len(parts)
        return
    assert len(files) == len(parts)
    for file in files:
        times = pq.read_table(file, columns=["tpep_pickup_datetime"]).column(0).to_pylist()
        assert times == sorted(times)
    assert _skipped_and_read(lake.silver, 5) == (8, 2)


def test_a_hot_month_is_cut_into_files_of_the_size_asked_for(spark, tmp_path, conf):
    """One source and month has nearly all rows."""
    lake = jobs.Lake(root=str(tmp_path), landing="")
    for source in DEFAULT_SPEC.sources:
        n = 400_000 if source == "yellow" else 2_000
        rows = spark.range(0, n, 1, 16).select(
            F.col("id").alias("VendorID"), F.lit(1.0).alias("passenger_count"),
            (F.rand(5) * 50).alias("total_amount"),
            F.timestamp_seconds(1677650000 + F.floor(F.rand(7) * 2_000_000)).alias("p"),
            (F.floor(F.rand(9) * 1800) + 1).alias("s"),
        ).select("VendorID", "passenger_count", "total_amount",
                 F.col("p").alias("tpep_pickup_datetime"),
                 F.timestamp_seconds(F.unix_timestamp("p") + F.col("s")).alias("tpep_dropoff_datetime"),
                 F.lit(source).alias("taxi_type"))
        rows.write.parquet(lake.bronze(source))
    file_bytes = 1 << 20
    run = jobs.silver(spark, lake, layout="rebalance", file_bytes=file_bytes)
    assert run.clean_rows == jobs.read_silver(spark, lake).count() > 300_000
    sizes = [f.stat().st_size for f in Path(lake.silver).rglob("taxi_type=yellow/*/*.parquet")]
    assert 4 <= len(sizes) and max(sizes) <= 2.5 * file_bytes
    assert sorted(sizes)[len(sizes) // 2] >= file_bytes / 3
    assert sinks._ADVISORY not in spark.conf.getAll


def test_unknown_layout(spark, lake):
    with pytest.raises(ValueError, match="sorted"):
        jobs.silver(spark, lake, layout="sorted")


# ------------------------------------------------------------------ months alone


def _spoil(lake, kept):
    """Every file of the cleaned table but those of one month loses its rows."""
    for file in Path(lake.silver).rglob("*.parquet"):
        if f"pickup_month={kept}" not in str(file):
            pq.write_table(pq.ParquetFile(file).read().slice(0, 0), file)
            crc = file.parent / f".{file.name}.crc"
            if crc.exists():
                crc.unlink()


def test_marts_from_a_kept_rollup(spark, lake):
    run = jobs.silver(spark, lake)
    jobs.gold(spark, lake)
    late = spark.read.parquet(lake.bronze("green"))
    more = frame(spark, [trip(pickup=datetime(2023, 3, 30, h), source="green", amount=77.0)
                         for h in range(20)], timestamp=T.TimestampType())
    late.union(more).write.parquet(lake.bronze("green") + "_new")
    overwrite_table(spark.read.parquet(lake.bronze("green") + "_new"), lake.bronze("green"))
    again = jobs.silver(spark, lake, months=[202303], fence=run.fence)
    stored = {name: df.collect() for name, df in jobs.gold(spark, lake).items()}
    assert again.clean_rows < run.clean_rows  # of that month alone
    jobs.gold(spark, lake)
    _spoil(lake, 202303)
    marts = jobs.gold(spark, lake, months=[202303])
    assert {name: df.collect() for name, df in marts.items()} == stored
    march = {r.taxi_type: r.total_corridas for r in marts["trips_by_taxi_type"].collect() if r.month == 3}
    assert march["green"] == march["yellow"] + 20


def test_a_month_that_lost_its_trips(spark, lake):
    run = jobs.silver(spark, lake)
    jobs.gold(spark, lake)
    for folder in Path(lake.silver).glob("taxi_type=*/pickup_month=202302"):
        for file in folder.iterdir():
            file.unlink()
        folder.rmdir()
    marts = jobs.gold(spark, lake, months=[202302])
    assert [r.month for r in marts["avg_total_by_month"].collect()] == [1, 3, 4, 5]
    jobs.silver(spark, lake, months=[202302], fence=run.fence)
    marts = jobs.gold(spark, lake, months=[202302])
    assert [r.month for r in marts["avg_total_by_month"].collect()] == [1, 2, 3, 4, 5]


def test_months_need_the_fence_of_the_others(spark, lake):
    with pytest.raises(ValueError, match="fence"):
        jobs.silver(spark, lake, months=[202303])


def test_a_fence_that_is_given(spark, lake):
    run = jobs.silver(spark, lake, fence=0.25)
    assert run.fence == 0.25 and run.rules["duration"].broken > 0


# ------------------------------------------------------------------ at once


def test_sources_are_stored_at_once(spark, sf_check, tmp_path, monkeypatch):
    """Each write waits for the other to have begun. One session's settings are nobody
    else's."""
    lake = jobs.Lake(root=str(tmp_path), landing=land_events(spark, sf_check), spec=EVENTS)
    both, real = threading.Barrier(2, timeout=120), jobs.overwrite_table
    before = spark.conf.getAll
    sessions = set()

    def write(df, *args, **how):
        both.wait()
        sessions.add(df.sparkSession._jsparkSession.sessionUUID())
        real(df, *args, **how)

    monkeypatch.setattr(jobs, "overwrite_table", write)
    run = jobs.bronze_all(spark, lake)
    assert run.total == 10_000 and len(sessions) == 2
    assert spark._jsparkSession.sessionUUID() not in sessions
    assert spark.conf.getAll == before


def test_a_session_of_its_own_has_the_callers_settings(spark, conf):
    conf(SPLIT, "12345k")
    own = own_session(spark)
    assert own.conf.get(SPLIT) == "12345k"
    own.conf.set(SPLIT, "1m")
    assert spark.conf.get(SPLIT) == "12345k"


def test_writes_with_other_settings_wait(spark, conf):
    conf(SPLIT, "7m")
    log = []

    def write(name, value, seconds):
        with sinks._settings(spark, {SPLIT: value}):
            log.append((name, "in", spark.conf.get(SPLIT)))
            time.sleep(seconds)
            log.append((name, "out", spark.conf.get(SPLIT)))

    jobs_ = [("a", "1m", 0.6), ("b", "1m", 0.6), ("c", "2m", 0.1)]
    threads = []
    for args in jobs_:
        threads.append(threading.Thread(target=write, args=args))
        threads[-1].start()
        time.sleep(0.1)
    for thread in threads:
        thread.join()
    assert [x[:2] for x in log[:2]] == [("a", "in"), ("b", "in")]
    assert log[-2:] == [("c", "in", "2m"), ("c", "out", "2m")]
    assert all(value == "1m" for _, _, value in log[:4])
    assert spark.conf.get(SPLIT) == "7m"


def test_one_job_that_fails(spark):
    def fail():
        raise KeyError("x")

    found = side_by_side(spark, {"a": lambda: 1, "b": fail})
    assert found["a"] == 1 and isinstance(found["b"], KeyError)
    assert side_by_side(spark, {}) == {}


# ------------------------------------------------------------------ drift


def _land(spark, folder, month, name, column, kind, mode="errorifexists"):
    df = frame(spark, [trip(vendor=7)]).drop("taxi_type")
    df = df.withColumn(column, F.col(column).cast(kind))
    df.write.mode(mode).parquet(f"{folder}/{name}_tripdata_2023-{month:02d}.parquet")


def test_text_in_a_number_column_of_another_month(spark, tmp_path):
    _land(spark, tmp_path, 1, "yellow", "VendorID", "int")
    _land(spark, tmp_path, 2, "yellow", "VendorID", "bigint")
    assert scan_landing(spark, str(tmp_path), "yellow").trips.count() == 2
    _land(spark, tmp_path, 3, "yellow", "VendorID", "string")
    with pytest.raises(DriftError) as caught:
        scan_landing(spark, str(tmp_path), "yellow")
    text = str(caught.value)
    assert "VendorID is int in" in text and "string in" in text
    assert "2023-01.parquet" in text and "2023-03.parquet" in text


def test_part_files_of_one_month_that_drifted(spark, tmp_path):
    """Numbers of several widths are read together; text is an error that names its file."""
    for kind in ("int", "bigint", "int", "double"):
        _land(spark, tmp_path, 1, "green", "VendorID", kind, mode="append")
    _land(spark, tmp_path, 4, "green", "VendorID", "int")
    scan = scan_landing(spark, str(tmp_path), "green")
    assert [r.VendorID for r in scan.trips.collect()] == [7.0] * 5
    assert scan.trips.schema["VendorID"].dataType == T.DoubleType()
    assert scan.found == ("2023-01", "2023-04")
    _land(spark, tmp_path, 1, "green", "VendorID", "string", mode="append")
    with pytest.raises(DriftError, match=r"VendorID is .* in .*part-.*parquet and .* in .*parquet"):
        scan_landing(spark, str(tmp_path), "green")


def test_other_errors_of_a_landed_file_are_passed_on(spark, tmp_path):
    (tmp_path / "yellow_tripdata_2023-01.parquet").write_bytes(b"no footer at all")
    with pytest.raises(Exception, match="(?i)footer|parquet"):
        scan_landing(spark, str(tmp_path), "yellow")


# ------------------------------------------------------------------ hand-over


def test_hand_over_is_whole_or_an_error(spark):
    df = spark.range(1000).orderBy(F.desc("id"))
    assert hand_over(df, 1000).column("id").to_pylist() == list(range(999, -1, -1))
    with pytest.raises(TooManyRowsError, match="999"):
        hand_over(df, 999)
    assert hand_over(spark.range(0), 0).num_rows == 0


def test_reports_are_handed_over(spark, lake, tmp_path, capsys):
    jobs.silver(spark, lake)
    jobs.gold(spark, lake)
    out = tmp_path / "out"
    where = ["report", "--root", lake.root, "--out", str(out)]
    with pytest.raises(TooManyRowsError):
        main([*where, "--most", "10"])  # the facets have more
    assert not out.exists()
    main(where)
    assert {f.name for f in out.iterdir()} == {f"{name}.csv" for name in jobs.REPORTS}
    lines = (out / "kpis.csv").read_text().splitlines()
    assert len(lines) == 3 and "ticket_medio" in lines[0]
    facets = jobs.report(spark, lake)["hour_facets"].count()
    assert len((out / "hour_facets.csv").read_text().splitlines()) == facets + 1


def test_command_line_replaces_a_month(spark, lake, capsys):
    main(["silver", "--root", lake.root, "--layout", "rebalance"])
    main(["gold", "--root", lake.root])
    before = _rows(jobs.read_mart(spark, lake, "trips_by_taxi_type"))
    fence = quality.iqr_fence(jobs.conformed(spark, lake))
    main(["silver", "--root", lake.root, "--changed", "202304", "--fence", str(fence)])
    main(["gold", "--root", lake.root, "--changed", "202304"])
    assert _rows(jobs.read_mart(spark, lake, "trips_by_taxi_type")) == before
