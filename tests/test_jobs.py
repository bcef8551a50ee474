"""Layer jobs on stored tables."""

import logging
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from rows import frame, trip

from curbside.__main__ import main
from curbside.operators.conform import ContractTypeError
from curbside.operators.marts import MARTS
from curbside.plans import jobs
from curbside.sources import NoLandedFilesError
from curbside.spec import DEFAULT_SPEC
from curbside.testbed import EVENTS, land_events


@pytest.fixture(scope="module")
def lake(spark, sf_check, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    lake = jobs.Lake(root=str(root), landing=land_events(spark, sf_check), spec=EVENTS)
    jobs.run_all(spark, lake)
    return lake


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_raw_layer(spark, lake):
    summary = dict(_rows(jobs.bronze_summary(spark, lake)))
    assert list(summary) == ["green", "yellow", "TOTAL"] and summary["TOTAL"] == 10000
    run = jobs.bronze_all(spark, lake)
    assert run.rows == {source: summary[source] for source in ("yellow", "green")}
    assert run.total == 10000 and run.missing == {"yellow": (), "green": ()}


def test_cleaned_layer(spark, lake):
    run = jobs.silver(spark, lake)
    assert run.fence == 2.521111111111111
    assert (run.raw_rows, run.clean_rows, run.removed_rows) == (10000, 5328, 4672)
    assert run.removed_pct == 46.7
    assert _rows(run.by_source) == [("green", 2111), ("yellow", 3217)]
    assert sum(r[1] for r in _rows(run.by_month)) == 5328
    stored = jobs.read_silver(spark, lake)
    assert stored.columns == EVENTS.contract
    folders = {path.split("/")[-3] for path in stored.inputFiles()}
    assert folders == {"taxi_type=green", "taxi_type=yellow"}


def test_marts(spark, lake):
    written = jobs.gold(spark, lake)
    assert {name: df.count() for name, df in written.items()} == {
        "avg_total_by_month": 5,
        "avg_passengers_by_hour": 24,
        "trips_by_taxi_type": 10,
        "top_hours_by_taxi_type": 48,
    }
    assert _rows(written["avg_total_by_month"])[0] == (1, 1086.81, 656)
    assert _rows(written["top_hours_by_taxi_type"])[:3] == [
        ("green", 4, 105), ("green", 14, 96), ("green", 18, 96)
    ]
    silver = jobs.read_silver(spark, lake)
    for name, mart in MARTS.items():
        assert _rows(written[name]) == _rows(mart(silver, EVENTS))


def test_a_rerun_does_not_double_rows(spark, lake):
    before = _rows(jobs.read_mart(spark, lake, "trips_by_taxi_type"))
    jobs.run_all(spark, lake)
    assert _rows(jobs.read_mart(spark, lake, "trips_by_taxi_type")) == before


def test_reports(spark, lake):
    sets = jobs.report(spark, lake)
    assert _rows(sets["kpis"]) == [("green", 2111, 1027.59), ("yellow", 3217, 1060.51)]
    assert sets["side_by_side"].count() == 5
    assert sets["hour_facets"].count() == 48
    assert set(MARTS) < set(sets)


def test_reports_before_any_run(spark, tmp_path):
    lake = jobs.Lake(root=str(tmp_path), landing="")
    with pytest.raises(jobs.NoMartsError, match="gold"):
        jobs.report(spark, lake)


def test_a_mart_that_was_not_stored_counts_as_empty(spark, lake, tmp_path):
    other = replace(lake, root=str(tmp_path))
    stored = jobs.read_mart(spark, lake, "trips_by_taxi_type")
    stored.write.parquet(other.gold("trips_by_taxi_type"))
    sets = jobs.report(spark, other)
    assert sets["month_table"].count() == 0 and sets["kpis"].count() == 2


def test_small_input_splits_do_not_make_small_files(spark, lake, tmp_path, conf):
    """400 input files and splits of 8 KB: the job cuts its input by the size of what it
    writes, and loses no row."""
    other = replace(lake, root=str(tmp_path))
    for source in EVENTS.sources:
        raw = spark.read.parquet(lake.bronze(source))
        raw.repartition(200).write.parquet(other.bronze(source))
    conf("spark.sql.files.maxPartitionBytes", "8k")
    conf("spark.sql.files.openCostInBytes", "1")
    run = jobs.silver(spark, other)
    assert run.clean_rows == 5328
    tasks = spark.sparkContext.defaultParallelism + 1
    months = len(EVENTS.landing_months)
    assert len(jobs.read_silver(spark, other).inputFiles()) <= 2 * tasks * months
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "8k"


def test_split_follows_the_columns_kept():
    assert jobs.split_for(160, 40, 128 << 20) == 512 << 20
    assert jobs.split_for(40, 40, 100) == jobs.split_for(10, 40, 100) == 100


def test_text_in_a_number_column_leaves_the_cleaned_table_alone(spark, lake, tmp_path):
    other = replace(lake, root=str(tmp_path))
    for source in EVENTS.sources:
        spark.read.parquet(lake.bronze(source)).write.parquet(other.bronze(source))
    jobs.silver(spark, other)
    before = jobs.read_silver(spark, other).inputFiles()
    raw = spark.read.parquet(lake.bronze("green"))
    column = EVENTS.passengers
    raw.withColumn(column, F.col(column).cast("string")).write.mode("overwrite").parquet(
        other.bronze("green")
    )
    with pytest.raises(ContractTypeError, match=f"green: {column} is string"):
        jobs.silver(spark, other)
    assert jobs.read_silver(spark, other).inputFiles() == before


def test_a_failing_source_does_not_stop_the_others(spark, tmp_path):
    landing = tmp_path / "landing"
    trips = frame(spark, [trip()]).drop("taxi_type")
    trips.write.parquet(f"{landing}/green_tripdata_2023-02.parquet")
    lake = jobs.Lake(root=str(tmp_path), landing=str(landing))
    with pytest.raises(jobs.BronzeError, match="yellow") as caught:
        jobs.bronze_all(spark, lake)
    run = caught.value.run
    assert run.rows == {"green": 1} and isinstance(run.failed["yellow"], NoLandedFilesError)
    assert len(run.missing["green"]) == 4


def test_nothing_to_clean(spark, tmp_path):
    lake = jobs.Lake(root=str(tmp_path), landing="")
    empty = frame(spark, [])
    for source in DEFAULT_SPEC.sources:
        empty.write.parquet(lake.bronze(source))
    with pytest.raises(ValueError, match="no forward-running trip"):
        jobs.silver(spark, lake)


def test_command_line(spark, tmp_path, capsys, caplog):
    """Published file names and columns, all layers, from the shell's point of view."""
    landing = tmp_path / "landing"
    for source, prefix in (("yellow", "tpep"), ("green", "lpep")):
        for month in (1, 5):
            df = frame(spark, [
                trip(pickup=trip()[3].replace(month=month, day=d), minutes=m, source=source)
                for d, m in ((3, 10), (4, 20), (5, 30), (6, 600))
            ]).drop("taxi_type").withColumn("extra", F.lit(1))
            for end in ("pickup", "dropoff"):
                df = df.withColumnRenamed(f"tpep_{end}_datetime", f"{prefix}_{end}_datetime")
            df.write.parquet(f"{landing}/{source}_tripdata_2023-0{month}.parquet")
    where = ["--root", str(tmp_path / "lake"), "--landing", str(landing)]
    with caplog.at_level(logging.INFO):
        for job in ("bronze", "silver", "gold", "report", "all"):
            main([job, *where])
    shown = capsys.readouterr().out
    assert shown.count("TOTAL") == 2  # `bronze` and `all`
    assert "Mês" in shown and "yellow_total_corridas" in shown
    lake = jobs.Lake(root=where[1], landing=where[3])
    assert _rows(jobs.read_mart(spark, lake, "avg_total_by_month")) == [(1, 42.25, 3), (5, 42.25, 3)]


def test_command_line_sets_months_and_period(spark, tmp_path):
    landing = tmp_path / "landing"
    for source in ("yellow", "green"):
        for day in (1, 2):
            pickup = trip()[3].replace(year=2024, month=7, day=day)
            rows = [trip(pickup=pickup, minutes=m, amount=float(day)) for m in (10, 20)]
            path = f"{landing}/{source}_tripdata_2024-07.parquet"
            frame(spark, rows).drop("taxi_type").write.mode("append").parquet(path)
    main([
        "all", "--root", str(tmp_path), "--landing", str(landing), "--months", "2024-07",
        "--period-start", "2024-07-01", "--period-end", "2024-07-02",
    ])
    lake = jobs.Lake(root=str(tmp_path), landing="")
    assert _rows(jobs.read_mart(spark, lake, "avg_total_by_month")) == [(7, 1.0, 2)]


def test_command_line_needs_a_landing_folder():
    with pytest.raises(SystemExit):
        main(["bronze", "--root", "/nowhere"])


def test_all_is_in_dependency_order(spark, lake, tmp_path):
    other = replace(lake, root=str(tmp_path))
    run = jobs.run_all(spark, other)
    assert run.bronze.total == run.silver.raw_rows == 10000
    assert _rows(run.marts["avg_total_by_month"]) == _rows(
        jobs.read_mart(spark, lake, "avg_total_by_month")
    )
