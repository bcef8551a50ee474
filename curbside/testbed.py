"""Trip feeds derived from the test tables, for queries, tests and the benchmark.

`trips_from_events` is the main feed: all events, spread over six months, with
every kind of defect the quality rules look for but two. `trips_from_shipments` has the
volume (one trip per line item) and those two: trips before the period, and null times. Each comes with the same feed as SQL text.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.sources import scratch_path
from curbside.spec import TripSpec

EVENTS = TripSpec(
    vendor="vendor_id",
    pickup="pickup_ts",
    dropoff="dropoff_ts",
    renames={
        "yellow": {"tpep_pickup_datetime": "pickup_ts", "tpep_dropoff_datetime": "dropoff_ts"},
        "green": {"lpep_pickup_datetime": "pickup_ts", "lpep_dropoff_datetime": "dropoff_ts"},
    },
    landing_months=("2024-01", "2024-02", "2024-03", "2024-04", "2024-05", "2024-06"),
    landing_name="file={source}_tripdata_{month}.parquet",
    period_start="2024-01-01",
    period_end="2024-05-31",
)

SHIPMENTS = replace(EVENTS, renames={}, period_start="1995-02-01", period_end="1995-05-31")

EVENTS_SQL = """
    SELECT user_id AS vendor_id,
           CASE WHEN event_id % 11 = 0 THEN NULL
                ELSE CAST(event_id % 7 AS DOUBLE) END AS passenger_count,
           CASE WHEN event_id % 13 = 0 THEN NULL ELSE value * 25 - 20 END AS total_amount,
           ts + to_days(CAST(30 * (event_id % 6) AS INTEGER)) AS pickup_ts,
           ts + to_days(CAST(30 * (event_id % 6) AS INTEGER))
              + to_seconds(CASE WHEN event_id % 17 = 0 THEN -60 ELSE round(value * 60) END)
              AS dropoff_ts,
           CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'yellow'
                ELSE 'green' END AS taxi_type
    FROM events
"""

SHIPMENTS_SQL = """
    SELECT l_suppkey AS vendor_id, l_quantity AS passenger_count,
           l_extendedprice AS total_amount,
           CASE WHEN l_orderkey % 19 <> 0 THEN o_orderdate END AS pickup_ts,
           CASE WHEN l_orderkey % 23 <> 0 THEN l_shipdate END AS dropoff_ts,
           CASE WHEN l_linestatus = 'O' THEN 'yellow' ELSE 'green' END AS taxi_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


# The columns read from each table. Stating them saves the footer job that would
# infer them.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "orders": "o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trips_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per event."""
    key, value = F.col("event_id"), F.col("value")
    pickup = F.timestamp_add("DAY", (30 * (key % 6)).cast("int"), F.col("ts"))
    seconds = F.when(key % 17 == 0, -60).otherwise(F.round(value * 60).cast("int"))
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vendor_id"),
        F.when(key % 11 != 0, (key % 7).cast("double")).alias("passenger_count"),
        F.when(key % 13 != 0, value * 25 - 20).alias("total_amount"),
        pickup.alias("pickup_ts"),
        F.timestamp_add("SECOND", seconds, pickup).alias("dropoff_ts"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "yellow")
        .otherwise("green")
        .alias("taxi_type"),
    )


def trips_from_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per line item: order date to ship date.

    The join carries no hint: Spark broadcasts `orders` only if it measures it to be
    small, and otherwise splits an order with very many lines while sort-merging.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("vendor_id"),
        F.col("l_quantity").alias("passenger_count"),
        F.col("l_extendedprice").alias("total_amount"),
        F.when(F.col("l_orderkey") % 19 != 0, F.col("o_orderdate")).alias("pickup_ts"),
        F.when(F.col("l_orderkey") % 23 != 0, F.col("l_shipdate")).alias("dropoff_ts"),
        F.when(F.col("l_linestatus") == "O", "yellow").otherwise("green").alias("taxi_type"),
    )


def land_events(spark: SparkSession, sf_dir: str, spec: TripSpec = EVENTS) -> str:
    """Land the event trips as drifting monthly files and return their folder.

    Odd months store the vendor as INT32 and passengers as DOUBLE, even months both
    as BIGINT and one column more. Each source has its own time column names. One
    write per source and schema, each laying out its months side by side.
    """
    landing = scratch_path(spark, "landing")
    trips = trips_from_events(spark, sf_dir)
    month = F.date_format(spec.pickup, "yyyy-MM")
    odd = F.month(spec.pickup) % 2 == 1
    for source in spec.sources:
        original = {ours: theirs for theirs, ours in spec.renames[source].items()}
        mine = (
            trips.filter(F.col(spec.source) == source)
            .withColumn("file", F.concat(F.lit(f"{source}_tripdata_"), month, F.lit(".parquet")))
            .drop(spec.source)
        )
        early = mine.filter(odd).withColumn(spec.vendor, F.col(spec.vendor).cast("int"))
        late = mine.filter(~odd).withColumns({
            spec.passengers: F.col(spec.passengers).cast("bigint"),
            "airport_fee": F.col(spec.amount) / 100,
        })
        for variant in (early, late):
            variant.withColumnsRenamed(original).write.mode("append").partitionBy("file").parquet(
                landing
            )
    return landing
