"""The four marts, from trips and from the rollup."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from rows import frame, trip

from curbside.operators.marts import (
    MARTS,
    avg_passengers_by_hour,
    avg_total_by_month,
    hourly_rollup,
    mart_schema,
    rollup_basis,
    top_hours_by_taxi_type,
    trips_by_taxi_type,
)
from curbside.operators.quality import clean, fence_column
from curbside.spec import DEFAULT_SPEC
from curbside.testbed import EVENTS, trips_from_events

MAY = datetime(2023, 5, 2, 9)
JAN = datetime(2023, 1, 2, 9)


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_avg_total_by_month(spark):
    rows = [trip(amount=10.0), trip(amount=10.25), trip(pickup=JAN, amount=1.0)]
    rows.append(trip(amount=99.0, source="green"))
    assert _rows(avg_total_by_month(frame(spark, rows))) == [(1, 1.0, 1), (4, 10.13, 2)]


def test_avg_passengers_by_hour_takes_all_sources_of_the_month(spark):
    rows = [
        trip(pickup=MAY, passengers=1.0),
        trip(pickup=MAY, passengers=4.0, source="green"),
        trip(pickup=datetime(2023, 5, 3, 23, 59), passengers=2.0),
        trip(pickup=datetime(2023, 4, 30, 9)),
    ]
    assert _rows(avg_passengers_by_hour(frame(spark, rows))) == [(9, 2.5, 2), (23, 2.0, 1)]


def test_the_month_of_every_year_of_the_period(spark):
    spec = replace(DEFAULT_SPEC, period_start="2021-03-01", period_end="2023-12-31")
    rows = [trip(pickup=datetime(year, 5, 31, 23, 59)) for year in (2021, 2022, 2023)]
    rows += [trip(pickup=datetime(year, 6, 1)) for year in (2021, 2022, 2023)]
    assert _rows(avg_passengers_by_hour(frame(spark, rows), spec)) == [(23, 3.0, 3)]


def test_the_month_counts_in_any_year_of_any_input(spark):
    """The period helps the scan; it is not a filter of its own."""
    years = (1999, 2022, 2023, 2024)
    rows = [trip(pickup=datetime(year, 5, day)) for year in years for day in (1, 31)]
    rows += [trip(pickup=datetime(2023, 5, 31, 12))]
    rows += [trip(pickup=datetime(year, month, 1)) for year in years for month in (4, 6)]
    assert _rows(avg_passengers_by_hour(frame(spark, rows))) == [(0, 3.0, 8), (12, 3.0, 1)]


@pytest.mark.parametrize("month", [1, 6, 12])
def test_any_month_may_be_asked_for(spark, month):
    spec = replace(DEFAULT_SPEC, period_end="2023-12-31", passengers_month=month)
    rows = [trip(pickup=datetime(2023, m, 1, m)) for m in range(1, 13)]
    assert _rows(avg_passengers_by_hour(frame(spark, rows), spec)) == [(month, 3.0, 1)]


def test_trips_by_type(spark):
    rows = [trip(), trip(passengers=4.0), trip(pickup=JAN), trip(source="green", amount=1.0)]
    assert _rows(trips_by_taxi_type(frame(spark, rows))) == [
        ("green", 4, 1, 1.0, 3.0),
        ("yellow", 1, 1, 42.25, 3.0),
        ("yellow", 4, 2, 42.25, 3.5),
    ]


def test_peak_hours_rank_all_hours_and_break_ties_by_hour(spark):
    hours = [5, 5, 7, 7, 1, 9, 9, 9]
    rows = [trip(pickup=datetime(2023, 3, 1, h)) for h in hours]
    assert _rows(top_hours_by_taxi_type(frame(spark, rows))) == [
        ("yellow", 9, 3), ("yellow", 5, 2), ("yellow", 7, 2), ("yellow", 1, 1)
    ]


@pytest.mark.parametrize("name", MARTS)
def test_rollup_gives_the_same_marts(spark, sf_check, name):
    trips = trips_from_events(spark, sf_check)
    silver = clean(trips, fence_column(trips, EVENTS), EVENTS)
    direct = MARTS[name](silver, EVENTS)
    derived = MARTS[name](hourly_rollup(silver, EVENTS), EVENTS, rollup_basis())
    assert _rows(direct) == _rows(derived)
    for df in (direct, derived):
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in mart_schema(name, EVENTS)
        ]


@pytest.mark.parametrize("name", MARTS)
def test_nulls_and_nan_average_alike(spark, name):
    """Uncleaned input: nulls do not count, NaN spreads, no value gives null."""
    rows = [
        trip(pickup=MAY, amount=None, passengers=None),
        trip(pickup=MAY, amount=5.0, passengers=None),
        trip(pickup=JAN, amount=None),
        trip(amount=float("nan"), passengers=float("nan")),
        trip(source=None),
    ]
    df = frame(spark, rows)
    direct = MARTS[name](df)
    derived = MARTS[name](hourly_rollup(df), DEFAULT_SPEC, rollup_basis())
    assert list(map(str, _rows(direct))) == list(map(str, _rows(derived)))


def test_marts_count_every_trip_whatever_the_partitioning(spark, sf_small):
    trips = trips_from_events(spark, sf_small)
    silver = clean(trips, fence_column(trips, EVENTS), EVENTS)
    for name in ("trips_by_taxi_type", "top_hours_by_taxi_type"):
        total = MARTS[name](silver, EVENTS).agg(F.sum("total_corridas")).first()[0]
        assert total == silver.count() == 545
        shuffled = silver.orderBy(F.rand(3)).repartition(7)
        assert _rows(MARTS[name](shuffled, EVENTS)) == _rows(MARTS[name](silver, EVENTS))
