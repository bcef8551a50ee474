"""Time expressions. All stay JVM-side and work on zoned and un-zoned timestamps."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside.spec import TripSpec

# Month labels of the report tables; other months have no label.
MONTH_LABELS = {1: "Jan", 2: "Fev", 3: "Mar", 4: "Abr", 5: "Mai"}


def duration_seconds(spec: TripSpec) -> Column:
    """Trip length in whole seconds (each instant is truncated to its second first)."""
    return F.unix_timestamp(spec.dropoff) - F.unix_timestamp(spec.pickup)


def duration_hours(spec: TripSpec) -> Column:
    """Trip length as a double of hours."""
    return duration_seconds(spec) / 3600


def in_month(spec: TripSpec, month: int) -> Column:
    """Pickup falls in this month of the year, in a form the Parquet scan can use.

    `month(ts) = m` alone never reaches the scan. Inside the period of `spec` the same
    rows are also described by one plain timestamp range per year, and ranges do reach
    it. Rows outside the period are left to `month(ts) = m`, so the predicate means the
    same on any input; a table cleaned with `spec` has no such rows.

    Spark's Parquet reader skips row groups by such a range for zoned timestamps stored
    as 64-bit integers. It does not do so for un-zoned ones.
    """
    pickup = F.col(spec.pickup)
    first, last = int(spec.period_start[:4]), int(spec.period_end[:4])
    candidates = [pickup < F.lit(spec.period_start), pickup > F.lit(spec.period_end)]
    for year in range(first, last + 1):
        after = (year + 1, 1) if month == 12 else (year, month + 1)
        candidates.append(
            (pickup >= F.lit(f"{year:04d}-{month:02d}-01"))
            & (pickup < F.lit(f"{after[0]:04d}-{after[1]:02d}-01"))
        )
    return (F.month(pickup) == month) & reduce(or_, candidates)


def month_label(month: Column) -> Column:
    """Short name of the month; null for a month without a label."""
    pairs = [F.lit(part) for item in MONTH_LABELS.items() for part in item]
    return F.create_map(*pairs)[month]
