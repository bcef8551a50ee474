"""Renames, contract, unions."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import frame, trip

from curbside.operators.conform import (
    ContractTypeError,
    MixedTimestampsError,
    conform,
    drift_union,
    strict_union,
    tag_source,
)
from curbside.spec import DEFAULT_SPEC


def _green(df):
    return df.withColumnsRenamed({
        "tpep_pickup_datetime": "lpep_pickup_datetime",
        "tpep_dropoff_datetime": "lpep_dropoff_datetime",
    })


def test_conform_renames_and_cuts(spark):
    raw = _green(frame(spark, [trip(source="green")])).withColumn("trip_type", F.lit(1))
    assert conform(raw, "green").columns == DEFAULT_SPEC.contract


def test_conform_without_the_old_names(spark):
    assert conform(frame(spark, [trip()]), "green").count() == 1


def test_only_the_named_source_is_renamed(spark):
    with pytest.raises(AnalysisException):
        conform(_green(frame(spark, [trip()])), "yellow")


def test_missing_contract_column(spark):
    with pytest.raises(AnalysisException, match="passenger_count"):
        conform(frame(spark, [trip()]).drop("passenger_count"), "yellow")


@pytest.mark.parametrize(
    ("column", "kind"),
    [
        ("VendorID", "int"),
        ("VendorID", "smallint"),
        ("passenger_count", "bigint"),
        ("passenger_count", "float"),
        ("total_amount", "int"),
    ],
)
def test_narrower_numbers_widen(spark, column, kind):
    df = frame(spark, [trip(amount=15.0)])
    out = conform(df.withColumn(column, F.col(column).cast(kind)), "yellow")
    assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert out.columns == DEFAULT_SPEC.contract and out.collect() == df.collect()


@pytest.mark.parametrize(
    ("column", "kind"),
    [
        ("VendorID", "string"),
        ("VendorID", "double"),
        ("passenger_count", "string"),
        ("total_amount", "decimal(10,2)"),
        ("tpep_pickup_datetime", "date"),
    ],
)
def test_other_types_are_refused(spark, column, kind):
    df = frame(spark, [trip()])
    with pytest.raises(ContractTypeError, match=f"green: {column} is "):
        conform(df.withColumn(column, F.col(column).cast(kind)), "green")


def test_time_flavour_is_kept(spark):
    plain = frame(spark, [trip()], timestamp=T.TimestampNTZType())
    assert conform(plain, "yellow").schema == plain.schema


def test_tag(spark):
    df = tag_source(frame(spark, [trip(source=None)]), "green")
    assert df.first().taxi_type == "green"


def test_drift_union_widens_and_fills(spark):
    a = spark.createDataFrame([(1, 1.5, 0.5)], "id int, n double, airport_fee double")
    b = spark.createDataFrame(
        [(2**40, 2, 1.25, "x")], "id bigint, n bigint, Airport_fee double, more string"
    )
    both = drift_union([a, b])
    assert {f.name: f.dataType for f in both.schema} == {
        "id": T.LongType(),
        "n": T.DoubleType(),
        "airport_fee": T.DoubleType(),
        "more": T.StringType(),
    }
    assert sorted(map(tuple, both.collect())) == [(1, 1.5, 0.5, None), (2**40, 2.0, 1.25, "x")]


def test_strict_union_by_name_keeps_duplicates(spark):
    a = frame(spark, [trip(), trip()])
    b = a.select(*reversed(a.columns))
    assert strict_union([a, b]).columns == a.columns
    assert strict_union([a, b]).count() == 4


def test_strict_union_of_different_widths(spark):
    a = frame(spark, [trip()])
    with pytest.raises(AnalysisException):
        strict_union([a, a.withColumn("more", F.lit(1))])


@pytest.mark.parametrize("union", [strict_union, drift_union])
def test_mixed_time_flavours_are_refused(spark, union):
    zoned = frame(spark, [trip()])
    plain = frame(spark, [trip()], timestamp=T.TimestampNTZType())
    with pytest.raises(MixedTimestampsError, match="tpep_pickup_datetime"):
        union([zoned, plain])
    assert union([plain, plain]).schema == plain.schema
