"""Result sets for people: labels, KPIs and comparisons, all over the marts.

The inputs have a few dozen rows; everything still stays a DataFrame, and whoever
draws the chart converts it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.time import month_label
from curbside.spec import (
    AVG_AMOUNT,
    AVG_PASSENGERS,
    DEFAULT_SPEC,
    HOUR,
    MONTH,
    TRIPS,
    TripSpec,
)

MONTH_NAME = "mes_nome"
TICKET = "ticket_medio"

# Display names of the two report tables.
MONTH_TABLE = {MONTH_NAME: "Mês", AVG_AMOUNT: "Média (USD)", TRIPS: "Total corridas"}
HOUR_TABLE = {HOUR: "Hora", AVG_PASSENGERS: "Média passageiros", TRIPS: "Total corridas"}


def with_month_label(df: DataFrame) -> DataFrame:
    """Month as an integer, with its short name beside it."""
    return df.withColumn(MONTH, F.col(MONTH).cast("int")).withColumn(
        MONTH_NAME, month_label(F.col(MONTH))
    )


def display(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the columns in `names`, under their display names."""
    return df.select(*[F.col(column).alias(name) for column, name in names.items()])


def month_table(avg_total_by_month: DataFrame) -> DataFrame:
    """Mean amount per month, labelled, in calendar order."""
    return display(with_month_label(avg_total_by_month).orderBy(MONTH), MONTH_TABLE)


def hour_table(avg_passengers_by_hour: DataFrame) -> DataFrame:
    """Mean passengers per hour, in order of the day."""
    hours = avg_passengers_by_hour.withColumn(HOUR, F.col(HOUR).cast("int"))
    return display(hours.orderBy(HOUR), HOUR_TABLE)


def type_table(trips_by_taxi_type: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Trips and means per source and labelled month."""
    return (
        with_month_label(trips_by_taxi_type)
        .orderBy(spec.source, MONTH)
        .select(spec.source, MONTH_NAME, TRIPS, AVG_AMOUNT, AVG_PASSENGERS)
    )


def source_slice(
    df: DataFrame, source: str, by: str, spec: TripSpec = DEFAULT_SPEC
) -> DataFrame:
    """One source's rows of a mart, ordered by month or hour."""
    return df.filter(F.col(spec.source) == source).orderBy(by)


def kpis(trips_by_taxi_type: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Trips and average ticket per source.

    The ticket is the plain mean of the stored monthly means, each month counting
    the same; it is not the mean over trips.
    """
    return (
        trips_by_taxi_type.groupBy(spec.source)
        .agg(F.sum(TRIPS).alias(TRIPS), F.round(F.avg(AVG_AMOUNT), 2).alias(TICKET))
        .orderBy(spec.source)
    )


def side_by_side(trips_by_taxi_type: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Trips and ticket of all sources next to each other, one row per month.

    Sources are aligned by month, not by position: a month one source lacks is null
    on its side. Columns are `<source>_<measure>`.
    """
    measures = [F.max(name).alias(name) for name in (TRIPS, AVG_AMOUNT)]
    wide = trips_by_taxi_type.groupBy(MONTH).pivot(spec.source, list(spec.sources)).agg(*measures)
    sides = [c for c in wide.columns if c != MONTH]
    return with_month_label(wide).select(MONTH, MONTH_NAME, *sides).orderBy(MONTH)


def hour_facets(top_hours_by_taxi_type: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Trips by hour of the day, one run of hours per source."""
    hours = top_hours_by_taxi_type.withColumn(HOUR, F.col(HOUR).cast("int"))
    return hours.orderBy(spec.source, HOUR)
