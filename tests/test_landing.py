"""Landed monthly files."""

import logging
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.sources import NoLandedFilesError, scan_landing
from curbside.spec import DEFAULT_SPEC
from curbside.testbed import EVENTS, land_events


def _land(spark, folder, month, columns, rows=3, source="yellow"):
    df = spark.range(rows).selectExpr(*columns)
    df.coalesce(1).write.parquet(f"{folder}/{source}_tripdata_2023-{month}.parquet")


def test_drift_across_months(spark, tmp_path):
    """INT32 / BIGINT / DOUBLE for one column, a column that comes late, one that
    changes its case: the plain reader settings cope."""
    _land(spark, tmp_path, "01", ["cast(id as int) VendorID", "1.5D n", "0.5D airport_fee"])
    _land(spark, tmp_path, "02", ["id VendorID", "2L n", "cast(0.5 as double) Airport_fee"])
    _land(spark, tmp_path, "03", ["cast(id as int) VendorID", "3.5D n", "0.5D airport_fee"], 5)
    _land(spark, tmp_path, "05", ["id VendorID", "4L n", "'x' more"])
    scan = scan_landing(spark, str(tmp_path), "yellow")
    assert scan.found == ("2023-01", "2023-02", "2023-03", "2023-05")
    assert scan.missing == ("2023-04",)
    assert {f.name: f.dataType for f in scan.trips.schema} == {
        "VendorID": T.LongType(),
        "n": T.DoubleType(),
        "airport_fee": T.DoubleType(),
        "taxi_type": T.StringType(),
        "more": T.StringType(),
    }
    counts = scan.trips.groupBy("n").agg(
        F.count("*").alias("rows"),
        F.count("airport_fee").alias("fees"),
        F.count("more").alias("more"),
    )
    assert sorted(map(tuple, counts.collect())) == [
        (1.5, 3, 3, 0), (2.0, 3, 3, 0), (3.5, 5, 5, 0), (4.0, 3, 0, 3)
    ]
    assert [r[0] for r in scan.trips.select("taxi_type").distinct().collect()] == ["yellow"]


def test_a_column_without_any_value(spark, tmp_path):
    """Its file may give it no type at all; other months decide."""
    fees = {"01": pa.nulls(2), "02": pa.array([1.5, None]), "03": pa.nulls(2)}
    for month, fee in fees.items():
        table = pa.table({"VendorID": [1, 2], "ehail_fee": fee})
        pq.write_table(table, f"{tmp_path}/yellow_tripdata_2023-{month}.parquet")
    trips = scan_landing(spark, str(tmp_path), "yellow").trips
    assert dict(trips.dtypes)["ehail_fee"] == "double"
    trips.write.parquet(f"{tmp_path}/stored")
    counts = spark.read.parquet(f"{tmp_path}/stored").selectExpr("count(*)", "count(ehail_fee)")
    assert tuple(counts.first()) == (6, 1)


def test_months_with_equal_schemas_share_a_scan(spark, tmp_path):
    for month in ("01", "02", "03", "04", "05"):
        _land(spark, tmp_path, month, ["id VendorID"])
    scan = scan_landing(spark, str(tmp_path), "yellow")
    assert scan.trips.count() == 15
    plan = scan.trips._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_part_files_of_one_month_may_differ(spark, tmp_path):
    path = f"{tmp_path}/yellow_tripdata_2023-01.parquet"
    spark.range(2).selectExpr("id VendorID").write.parquet(path)
    spark.range(2).selectExpr("id VendorID", "'late' more").write.mode("append").parquet(path)
    scan = scan_landing(spark, str(tmp_path), "yellow")
    assert set(scan.trips.columns) == {"VendorID", "more", "taxi_type"}
    assert scan.trips.where("more is null").count() == 2


def test_missing_months_are_logged(spark, tmp_path, caplog):
    _land(spark, tmp_path, "02", ["id VendorID"])
    with caplog.at_level(logging.WARNING):
        assert scan_landing(spark, str(tmp_path), "yellow").found == ("2023-02",)
    assert sum("skipped" in message for message in caplog.messages) == 4


def test_nothing_landed(spark, tmp_path):
    _land(spark, tmp_path, "02", ["id VendorID"])
    with pytest.raises(NoLandedFilesError, match="green"):
        scan_landing(spark, str(tmp_path), "green")


def test_unreadable_file_is_an_error(spark, tmp_path):
    _land(spark, tmp_path, "02", ["id VendorID"])
    (tmp_path / "yellow_tripdata_2023-03.parquet").write_text("not a table")
    with pytest.raises(Exception) as caught:
        scan_landing(spark, str(tmp_path), "yellow")
    assert not isinstance(caught.value, NoLandedFilesError)


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "yellow_tripdata_2023-03.parquet").mkdir()
    with pytest.raises(AnalysisException):
        scan_landing(spark, str(tmp_path), "yellow")


def test_fewer_months_are_asked_for(spark, sf_small):
    landing = land_events(spark, sf_small)
    spec = replace(EVENTS, landing_months=("2024-02", "2024-03"))
    scans = [scan_landing(spark, landing, source, spec) for source in spec.sources]
    whole = [scan_landing(spark, landing, source, EVENTS) for source in spec.sources]
    assert 0 < sum(s.trips.count() for s in scans) < sum(s.trips.count() for s in whole) == 1000


def test_plain_files_work_like_folders(spark, tmp_path):
    spark.range(4).selectExpr("id VendorID").coalesce(1).write.parquet(f"{tmp_path}/out")
    part = next((tmp_path / "out").glob("part-*.parquet"))
    (tmp_path / "yellow_tripdata_2023-01.parquet").write_bytes(part.read_bytes())
    assert scan_landing(spark, str(tmp_path), "yellow", DEFAULT_SPEC).trips.count() == 4
