"""What a trip feed looks like: column roles, sources, period and quality bounds.

Every operator takes a `TripSpec`, so the same plans run on the published monthly
files (the defaults) and on any other table with the same six roles.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Output names of the stored tables and the label that the
# ingest summary gives its grand total.
MONTH = "month"
HOUR = "hour"
TRIPS = "total_corridas"
AVG_AMOUNT = "avg_total_amount"
AVG_PASSENGERS = "avg_passengers"
TOTAL_LABEL = "TOTAL"


def _default_renames() -> Mapping[str, Mapping[str, str]]:
    return {
        "green": {
            "lpep_pickup_datetime": "tpep_pickup_datetime",
            "lpep_dropoff_datetime": "tpep_dropoff_datetime",
        }
    }


@dataclass(frozen=True)
class TripSpec:
    """Column roles and bounds of one trip feed.

    `period_start` and `period_end` are both inclusive *instants*: a plain date
    means its midnight, so the default period ends at 2023-05-31 00:00:00 and
    trips picked up later that day are outside it.
    """

    vendor: str = "VendorID"
    passengers: str = "passenger_count"
    amount: str = "total_amount"
    pickup: str = "tpep_pickup_datetime"
    dropoff: str = "tpep_dropoff_datetime"
    source: str = "taxi_type"

    sources: tuple[str, ...] = ("yellow", "green")
    renames: Mapping[str, Mapping[str, str]] = field(default_factory=_default_renames)

    landing_months: tuple[str, ...] = ("2023-01", "2023-02", "2023-03", "2023-04", "2023-05")
    landing_name: str = "{source}_tripdata_{month}.parquet"

    period_start: str = "2023-01-01"
    period_end: str = "2023-05-31"
    amount_limit: float = 10000.0
    fence_factor: float = 1.5

    amount_source: str = "yellow"
    passengers_month: int = 5

    @property
    def contract(self) -> list[str]:
        """The six columns of the cleaned table, in order."""
        return [self.vendor, self.passengers, self.amount, self.pickup, self.dropoff, self.source]

    def contract_schema(self, timestamp: T.DataType | None = None) -> T.StructType:
        """The contract with its types; `timestamp` picks the zoned or un-zoned flavour."""
        instant = timestamp or T.TimestampType()
        return (
            T.StructType()
            .add(self.vendor, T.LongType())
            .add(self.passengers, T.DoubleType())
            .add(self.amount, T.DoubleType())
            .add(self.pickup, instant)
            .add(self.dropoff, instant)
            .add(self.source, T.StringType())
        )

    def table_name(self, source: str) -> str:
        """Folder of a source's raw table below the raw layer."""
        return f"{source}_taxi"


DEFAULT_SPEC = TripSpec()
