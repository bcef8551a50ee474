"""What the optimizer makes of the queries: these hold at any scale or not at all."""

import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import types as T
from rows import frame, plan, trip

import __spark_entry__ as entry
from curbside.functions import duration_seconds, quantiles
from curbside.operators import marts, quality
from curbside.plans import jobs
from curbside.sources import overwrite_table
from curbside.spec import DEFAULT_SPEC


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    lake = jobs.Lake(root=str(root), landing="")
    for source in DEFAULT_SPEC.sources:
        rows = [trip(source=source, minutes=m) for m in (10, 20, 30, 60)]
        frame(spark, rows).selectExpr("*", "'wide' as unused").write.parquet(lake.bronze(source))
    jobs.silver(spark, lake)
    return lake


def _scans(text):
    return re.findall(r"\n\(\d+\) Scan parquet.*?(?=\n\n)", text, re.S)


def test_rules_reach_the_raw_scan(spark, lake):
    cleaned = quality.clean(jobs.conformed(spark, lake), 1.0)
    scans = _scans(plan(cleaned))
    assert len(scans) == 2
    for scan in scans:
        pushed = re.search(r"PushedFilters: .*", scan)[0]
        for rule in (
            "GreaterThanOrEqual(tpep_pickup_datetime,",
            "LessThanOrEqual(tpep_pickup_datetime,",
            "GreaterThan(passenger_count,0.0)",
            "GreaterThanOrEqual(total_amount,0.0)",
            "LessThan(total_amount,10000.0)",
        ):
            assert rule in pushed
        assert "unused" not in scan
    assert "Exchange" not in plan(cleaned)


def test_fence_scans_the_two_times_once(spark, lake):
    population = quality.fence_population(jobs.conformed(spark, lake))
    text = plan(quantiles.sketch(population, duration_seconds(DEFAULT_SPEC), 23))
    assert len(_scans(text)) == 2  # one for each raw table
    for scan in _scans(text):
        assert re.search(r"ReadSchema: (.*)", scan)[1] == (
            "struct<tpep_pickup_datetime:timestamp,tpep_dropoff_datetime:timestamp>"
        )


def test_sketch_combines_before_its_only_shuffle(spark, lake):
    silver = jobs.read_silver(spark, lake)
    text = plan(quantiles.sketch(silver, duration_seconds(DEFAULT_SPEC), 23))
    assert len(_scans(text)) == 1 and "partial_count(1)" in text
    assert len(re.findall(r"\n\(\d+\) Exchange", text)) == 1


def test_one_source_reads_one_partition(spark, lake):
    text = plan(marts.avg_total_by_month(jobs.read_silver(spark, lake)))
    (scan,) = _scans(text)
    assert "PartitionFilters: [isnotnull(taxi_type" in scan and "= yellow)" in scan
    assert "passenger_count" not in re.search(r"ReadSchema: (.*)", scan)[1]


def test_one_month_reaches_the_scan(spark, lake):
    (scan,) = _scans(plan(marts.avg_passengers_by_hour(jobs.read_silver(spark, lake))))
    pushed = re.search(r"PushedFilters: .*", scan)[0]
    assert "GreaterThanOrEqual(tpep_pickup_datetime,2023-05-01" in pushed
    assert "LessThan(tpep_pickup_datetime,2023-06-01" in pushed
    assert "total_amount" not in re.search(r"ReadSchema: (.*)", scan)[1]


def test_one_month_of_several_years_reaches_the_scan(spark, lake):
    spec = replace(DEFAULT_SPEC, period_start="2021-07-01")
    (scan,) = _scans(plan(marts.avg_passengers_by_hour(jobs.read_silver(spark, lake), spec)))
    pushed = re.search(r"PushedFilters: .*", scan)[0]
    assert pushed.count("Or(") == 4
    for year in (2021, 2022, 2023):
        assert f"GreaterThanOrEqual(tpep_pickup_datetime,{year}-05-01" in pushed


@pytest.mark.parametrize("flavour", [T.TimestampType(), T.TimestampNTZType()], ids=str)
def test_one_month_skips_the_others(spark, tmp_path, flavour):
    """Only May is decoded: zoned times by row group, un-zoned ones by partition."""
    lake = jobs.Lake(root=str(tmp_path), landing="")
    months = [trip(pickup=datetime(2023, m, d), minutes=10 + d) for m in range(1, 6) for d in (1, 2)]
    for source in DEFAULT_SPEC.sources:
        df = frame(spark, [(*row[:5], source) for row in months], timestamp=flavour)
        by_month = df.repartitionByRange(5, "tpep_pickup_datetime")
        overwrite_table(by_month, lake.bronze(source))
    jobs.silver(spark, lake)
    df = marts.avg_passengers_by_hour(jobs.read_silver(spark, lake, month=5))
    assert [tuple(r) for r in df.collect()] == [(0, 3.0, 4)]
    assert _scanned_rows(df) == 4


def test_month_partition_does_not_tie_zoned_times_to_a_zone(spark, tmp_path, conf):
    """Stored in one zone, read in another, where some trips are of the month before."""
    conf("spark.sql.session.timeZone", "UTC")
    lake = jobs.Lake(root=str(tmp_path), landing="")
    pickups = [datetime(2023, 5, 1, 2), datetime(2023, 5, 1, 9), datetime(2023, 4, 20, 9)]
    for source in DEFAULT_SPEC.sources:
        rows = [trip(pickup=p, source=source) for p in pickups]
        overwrite_table(frame(spark, rows, timestamp=T.TimestampType()), lake.bronze(source))
    jobs.silver(spark, lake)
    conf("spark.sql.session.timeZone", "America/New_York")
    assert jobs.read_silver(spark, lake, month=4).count() == 4
    assert jobs.read_silver(spark, lake, month=5).count() == 2


def _scanned_rows(df):
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            rows += node.metrics().apply("numOutputRows").value()
        elif kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_rollup_is_one_scan_with_partial_sums(spark, lake):
    text = plan(marts.hourly_rollup(jobs.read_silver(spark, lake)))
    assert len(_scans(text)) == 1
    assert "partial_sum(total_amount" in text and "partial_count(1)" in text


def test_counting_reads_no_columns(spark, lake):
    text = plan(jobs.conformed(spark, lake).groupBy().count())
    assert all("ReadSchema: struct<>" in scan for scan in _scans(text))


def test_stored_marts_are_ordered_without_a_shuffle(spark, lake):
    jobs.gold(spark, lake)
    for name in marts.MARTS:
        assert "Exchange" not in plan(jobs.read_mart(spark, lake, name))
    assert "Exchange" not in plan(jobs.report(spark, lake)["kpis"])


@pytest.mark.parametrize("name", {q.__name__: q for q in entry._QUERIES})
def test_no_python_and_no_cross_join_anywhere(spark, sf_small, name):
    text = plan({q.__name__: q for q in entry._QUERIES}[name](spark, sf_small))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text
