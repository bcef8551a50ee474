"""The four aggregate tables.

Each mart is defined once, in terms of a `Basis`: the expressions for its keys and
measures. The basis is either the cleaned trips themselves, or an hourly rollup of
them. A user who wants one mart aggregates the trips and scans only the columns
and partitions that mart needs; the job that builds all four scans the trips once,
into a rollup of a few hundred rows, and derives the marts from that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.functions.time import in_month
from curbside.spec import (
    AVG_AMOUNT,
    AVG_PASSENGERS,
    DEFAULT_SPEC,
    HOUR,
    MONTH,
    TRIPS,
    TripSpec,
)


@dataclass(frozen=True)
class Basis:
    """Keys and measures of the marts over one kind of input."""

    month: Column
    hour: Column
    trips: Column
    mean_amount: Column
    mean_passengers: Column
    in_month: Callable[[int], Column]


def trip_basis(spec: TripSpec = DEFAULT_SPEC) -> Basis:
    """Marts straight from trips."""
    return Basis(
        month=F.month(spec.pickup).alias(MONTH),
        hour=F.hour(spec.pickup).alias(HOUR),
        trips=F.count("*"),
        mean_amount=F.avg(spec.amount),
        mean_passengers=F.avg(spec.passengers),
        in_month=lambda month: in_month(spec, month),
    )


def rollup_basis() -> Basis:
    """Marts from the hourly rollup. An average is the sum of sums over the sum of
    counts, as Spark's own two-phase `avg` computes it."""
    return Basis(
        month=F.col(MONTH),
        hour=F.col(HOUR),
        trips=F.sum("trips"),
        mean_amount=F.try_divide(F.sum("amount_sum"), F.sum("amount_n")),
        mean_passengers=F.try_divide(F.sum("passengers_sum"), F.sum("passengers_n")),
        in_month=lambda month: F.col(MONTH) == month,
    )


def hourly_rollup(trips: DataFrame, spec: TripSpec = DEFAULT_SPEC, *keys: str) -> DataFrame:
    """Partial sums per source, month and hour (and further `keys`): at most 12 * 24 rows
    per source.

    Everything the marts need, in one scan. Map-side combining reduces every task
    to that many rows before the shuffle, however unevenly sources are filled.
    """
    return trips.groupBy(
        spec.source, *keys, F.month(spec.pickup).alias(MONTH), F.hour(spec.pickup).alias(HOUR)
    ).agg(
        F.count("*").alias("trips"),
        F.sum(spec.amount).alias("amount_sum"),
        F.count(spec.amount).alias("amount_n"),
        F.sum(spec.passengers).alias("passengers_sum"),
        F.count(spec.passengers).alias("passengers_n"),
    )


def avg_total_by_month(
    df: DataFrame, spec: TripSpec = DEFAULT_SPEC, basis: Basis | None = None
) -> DataFrame:
    """Mean amount and trips per month, for the one source `spec.amount_source`."""
    b = basis or trip_basis(spec)
    return (
        df.filter(F.col(spec.source) == spec.amount_source)
        .groupBy(b.month)
        .agg(F.round(b.mean_amount, 2).alias(AVG_AMOUNT), b.trips.alias(TRIPS))
        .orderBy(*mart_order("avg_total_by_month", spec))
    )


def avg_passengers_by_hour(
    df: DataFrame, spec: TripSpec = DEFAULT_SPEC, basis: Basis | None = None
) -> DataFrame:
    """Mean passengers and trips per hour of the day in `spec.passengers_month`."""
    b = basis or trip_basis(spec)
    return (
        df.filter(b.in_month(spec.passengers_month))
        .groupBy(b.hour)
        .agg(F.round(b.mean_passengers, 2).alias(AVG_PASSENGERS), b.trips.alias(TRIPS))
        .orderBy(*mart_order("avg_passengers_by_hour", spec))
    )


def trips_by_taxi_type(
    df: DataFrame, spec: TripSpec = DEFAULT_SPEC, basis: Basis | None = None
) -> DataFrame:
    """Trips, mean amount and mean passengers per source and month."""
    b = basis or trip_basis(spec)
    return (
        df.groupBy(spec.source, b.month)
        .agg(
            b.trips.alias(TRIPS),
            F.round(b.mean_amount, 2).alias(AVG_AMOUNT),
            F.round(b.mean_passengers, 2).alias(AVG_PASSENGERS),
        )
        .orderBy(*mart_order("trips_by_taxi_type", spec))
    )


def top_hours_by_taxi_type(
    df: DataFrame, spec: TripSpec = DEFAULT_SPEC, basis: Basis | None = None
) -> DataFrame:
    """All hours of the day per source, busiest first."""
    b = basis or trip_basis(spec)
    return (
        df.groupBy(spec.source, b.hour)
        .agg(b.trips.alias(TRIPS))
        .orderBy(*mart_order("top_hours_by_taxi_type", spec))
    )


MARTS: dict[str, Callable[..., DataFrame]] = {
    "avg_total_by_month": avg_total_by_month,
    "avg_passengers_by_hour": avg_passengers_by_hour,
    "trips_by_taxi_type": trips_by_taxi_type,
    "top_hours_by_taxi_type": top_hours_by_taxi_type,
}


def mart_order(name: str, spec: TripSpec = DEFAULT_SPEC) -> list[Column]:
    """The order a mart is shown in. File order is no contract, so readers apply it
    again. Equal hours are ranked by the hour itself, so the order is total."""
    return {
        "avg_total_by_month": [F.col(MONTH)],
        "avg_passengers_by_hour": [F.col(HOUR)],
        "trips_by_taxi_type": [F.col(spec.source), F.col(MONTH)],
        "top_hours_by_taxi_type": [F.col(spec.source), F.desc(TRIPS), F.col(HOUR)],
    }[name]


def mart_schema(name: str, spec: TripSpec = DEFAULT_SPEC) -> T.StructType:
    """The stored columns of a mart."""
    types = {
        spec.source: T.StringType(),
        MONTH: T.IntegerType(),
        HOUR: T.IntegerType(),
        TRIPS: T.LongType(),
        AVG_AMOUNT: T.DoubleType(),
        AVG_PASSENGERS: T.DoubleType(),
    }
    columns = {
        "avg_total_by_month": [MONTH, AVG_AMOUNT, TRIPS],
        "avg_passengers_by_hour": [HOUR, AVG_PASSENGERS, TRIPS],
        "trips_by_taxi_type": [spec.source, MONTH, TRIPS, AVG_AMOUNT, AVG_PASSENGERS],
        "top_hours_by_taxi_type": [spec.source, HOUR, TRIPS],
    }[name]
    return T.StructType([T.StructField(column, types[column]) for column in columns])
