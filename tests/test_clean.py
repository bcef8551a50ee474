"""The cleaning filter, rule by rule."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import START, frame, trip

from curbside.operators.quality import clean, cleaning_report, trips_by_month, trips_by_source
from curbside.spec import DEFAULT_SPEC

NAN = float("nan")
MIDNIGHT = datetime(2023, 5, 31)

KEPT = {
    "valid": trip(),
    "half an hour under a 0.645 h fence": (trip(minutes=30), 0.645),
    "amount zero": trip(amount=0.0),
    "amount just below the limit": trip(amount=9999.99),
    "passengers NaN": trip(passengers=NAN),
    "first instant of the period": trip(pickup=datetime(2023, 1, 1)),
    "last instant of the period": trip(pickup=MIDNIGHT),
    "exactly as long as the fence": trip(minutes=60),
    "vendor null": trip(vendor=None),
    "source null": trip(source=None),
    "less than a second long": trip(
        pickup=START.replace(microsecond=100000), dropoff=START.replace(microsecond=900000)
    ),
    "a second over the fence, cut to whole seconds": trip(
        pickup=START.replace(microsecond=900000),
        dropoff=START + timedelta(hours=1, microseconds=100000),
    ),
}

REMOVED = {
    "no passengers": trip(passengers=0.0),
    "negative passengers": trip(passengers=-1.0),
    "passengers null": trip(passengers=None),
    "negative amount": trip(amount=-5.0),
    "amount far too high": trip(amount=15000.0),
    "amount at the limit": trip(amount=10000.0),
    "amount null": trip(amount=None),
    "amount NaN": trip(amount=NAN),
    "after the period": trip(pickup=datetime(2023, 6, 10, 8)),
    "before the period": trip(pickup=datetime(2022, 12, 31, 23)),
    "a second before the period": trip(pickup=datetime(2022, 12, 31, 23, 59, 59)),
    "later on the last day": trip(pickup=MIDNIGHT + timedelta(seconds=1)),
    "ends before it starts": trip(minutes=-30),
    "ends as it starts": trip(minutes=0),
    "two hours under a 0.645 h fence": (trip(minutes=120), 0.645),
    "a second longer than the fence": trip(dropoff=START + timedelta(hours=1, seconds=1)),
    "pickup null": trip(pickup=None, dropoff=START),
    "dropoff null": trip(dropoff=None),
}


def _case(case):
    return case if len(case) == 2 else (case, 1.0)


@pytest.mark.parametrize("flavour", [T.TimestampType(), T.TimestampNTZType()], ids=str)
def test_each_rule(spark, flavour):
    """All cases in one frame per fence, told apart by the vendor column."""
    outcome = {}
    cases = [(name, _case(c)) for name, c in {**KEPT, **REMOVED}.items()]
    for fence in {fence for _, (_, fence) in cases}:
        mine = [(name, row) for name, (row, f) in cases if f == fence]
        rows = [(i, *row[1:]) for i, (_, row) in enumerate(mine)]
        left = {r[0] for r in clean(frame(spark, rows, timestamp=flavour), fence).collect()}
        outcome |= {name: i in left for i, (name, _) in enumerate(mine)}
    assert outcome == {**dict.fromkeys(KEPT, True), **dict.fromkeys(REMOVED, False)}


def test_vendor_is_not_tested(spark):
    assert clean(frame(spark, [trip(vendor=None), trip(source=None)]), 1.0).count() == 2


def test_mixture_and_columns(spark):
    rows = [
        trip(),
        trip(passengers=0.0),
        trip(pickup=datetime(2023, 7, 1, 8)),
        trip(pickup=datetime(2023, 1, 5, 9), minutes=25, source="green"),
    ]
    df = frame(spark, rows)
    left = clean(df, 1.0)
    assert left.columns == DEFAULT_SPEC.contract
    assert left.schema == df.schema
    assert sorted(r.taxi_type for r in left.collect()) == ["green", "yellow"]


def test_duplicates_are_kept(spark):
    assert clean(frame(spark, [trip()] * 3), 1.0).count() == 3


def test_clean_is_idempotent_and_report_adds_up(spark):
    rows = [_case(c)[0] for c in [*KEPT.values(), *REMOVED.values()]]
    df = frame(spark, rows)
    once = clean(df, 1.0)
    assert clean(once, 1.0).count() == once.count()
    report = cleaning_report(df, 1.0).first()
    assert report.raw_rows == len(rows)
    assert report.clean_rows == once.count()
    assert report.removed_rows == report.raw_rows - report.clean_rows
    assert report.removed_pct == round(report.removed_rows / report.raw_rows * 100, 1)


def test_report_of_nothing(spark):
    report = cleaning_report(frame(spark, []), 1.0).first()
    assert tuple(report) == (0, 0, 0, None)


def test_fence_may_be_a_column(spark):
    df = frame(spark, [trip(), trip(minutes=90)])
    assert clean(df, F.lit(1.0)).count() == 1


def test_bounds_are_parameters(spark):
    spec = replace(DEFAULT_SPEC, period_end="2023-05-31 23:59:59", amount_limit=10.0)
    rows = [trip(pickup=MIDNIGHT + timedelta(hours=5), amount=9.0), trip(amount=11.0)]
    assert clean(frame(spark, rows), 1.0, spec).count() == 1


def test_distributions(spark):
    rows = [trip(), trip(source="green"), trip(pickup=datetime(2023, 1, 2)), trip()]
    df = frame(spark, rows)
    assert [tuple(r) for r in trips_by_source(df).collect()] == [("green", 1), ("yellow", 3)]
    assert [tuple(r) for r in trips_by_month(df).collect()] == [(1, 1), (4, 3)]
