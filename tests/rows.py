"""Tiny in-memory trips."""

from datetime import datetime, timedelta

from curbside.sources import from_rows as frame  # noqa: F401

START = datetime(2023, 4, 21, 17, 25)


def trip(
    vendor=6,
    passengers=3.0,
    amount=42.25,
    pickup=START,
    dropoff="minutes later",
    source="yellow",
    minutes=35,
):
    """One good trip, unless told otherwise."""
    if dropoff == "minutes later":
        dropoff = pickup + timedelta(minutes=minutes)
    return (vendor, passengers, amount, pickup, dropoff, source)


def plan(df):
    """The executed plan as text."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
