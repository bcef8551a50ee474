"""

Every query reads whole tables. The trip feeds are derived from `events` (and, for
volume, from `lineitem` and `orders`) as described in `curbside/testbed.py`.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curbside import testbed  # noqa: E402
from curbside.operators import marts, quality, reports  # noqa: E402
from curbside.operators.conform import conform, strict_union  # noqa: E402
from curbside.plans import jobs  # noqa: E402
from curbside.sources import (  # noqa: E402
    overwrite_table,
    preview,
    read_table,
    scan_landing,
    scratch_path,
)
from curbside.testbed import EVENTS, EVENTS_SQL, SHIPMENTS, SHIPMENTS_SQL  # noqa: E402

# ---------------------------------------------------------------- inputs


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.trips_from_events(spark, sf_dir)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _trips(spark, sf_dir)
    return quality.clean(trips, quality.fence_column(trips, EVENTS), EVENTS)


def _ship_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = testbed.trips_from_shipments(spark, sf_dir)
    return quality.clean(trips, quality.fence_column(trips, SHIPMENTS), SHIPMENTS)


def _landed_lake(spark: SparkSession, sf_dir: str, spec=EVENTS) -> jobs.Lake:
    landing = testbed.land_events(spark, sf_dir)
    return jobs.Lake(root=scratch_path(spark, "lake"), landing=landing, spec=spec)


# ---------------------------------------------------------------- raw layer


def _drift_union(spark: SparkSession, sf_dir: str, spec=EVENTS) -> DataFrame:
    """Both sources as their scans deliver them, side by side in one table."""
    lake = _landed_lake(spark, sf_dir, spec)
    yellow, green = (scan_landing(spark, lake.landing, s, spec).trips for s in spec.sources)
    return yellow.unionByName(green, allowMissingColumns=True)


def bronze_drift_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift_union(spark, sf_dir)


def bronze_missing_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 2024-07 and 2023-12 never landed; the months that did are all there.
    months = ("2023-12", *EVENTS.landing_months, "2024-07")
    return _drift_union(spark, sf_dir, replace(EVENTS, landing_months=months))


def bronze_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _landed_lake(spark, sf_dir)
    jobs.bronze_all(spark, lake)
    return jobs.bronze_summary(spark, lake)


# ---------------------------------------------------------------- cleaned layer


def silver_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _landed_lake(spark, sf_dir)
    return strict_union([
        conform(scan_landing(spark, lake.landing, source, EVENTS).trips, source, EVENTS)
        for source in EVENTS.sources
    ])


def trip_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbside.functions import duration_hours

    return _trips(spark, sf_dir).select(
        EVENTS.vendor, EVENTS.pickup, EVENTS.dropoff, duration_hours(EVENTS).alias("hours")
    )


def iqr_fence_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fence_stats(_trips(spark, sf_dir), EVENTS)


def iqr_fence_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quartile: the population's size, and whether the approximate value is an
    observed one whose rank is within size / accuracy of the wanted rank."""
    from curbside.functions import duration_hours

    accuracy = 10000
    trips = _trips(spark, sf_dir)
    stats = quality.fence_stats(trips, EVENTS, method="approx", accuracy=accuracy).first()
    hours = quality.fence_population(trips, EVENTS).select(duration_hours(EVENTS).alias("hours"))
    counts = [F.count("*").alias("size")]
    for name in ("p25", "p75"):
        value = F.lit(stats[name])
        counts += [
            F.count_if(F.col("hours") < value).alias(f"{name}_low"),
            F.count_if(F.col("hours") <= value).alias(f"{name}_upto"),
        ]
    slack = F.col("size") / accuracy + 1

    def quartile(name: str, share: float):
        low, upto = F.col(f"{name}_low"), F.col(f"{name}_upto")
        rank = F.col("size") * share
        within = (low < upto) & (low + 1 <= rank + slack) & (upto >= rank - slack)
        return F.struct(F.lit(share).alias("share"), "size", within.alias("within"))

    both = F.array(quartile("p25", 0.25), quartile("p75", 0.75))
    return hours.agg(*counts).select(F.inline(both))


def iqr_fence_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fence_stats(testbed.trips_from_shipments(spark, sf_dir), SHIPMENTS)


def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir)


def silver_clean_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship_silver(spark, sf_dir)


def silver_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _trips(spark, sf_dir)
    return quality.cleaning_report(trips, quality.fence_column(trips, EVENTS), EVENTS)


def silver_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule removes, counted in the write of the cleaned table."""
    lake = _landed_lake(spark, sf_dir)
    jobs.bronze_all(spark, lake)
    run = jobs.silver(spark, lake)
    counts = F.array(*(
        F.struct(
            F.lit(rule).alias("rule"), F.lit(n.broken).cast("bigint").alias("broken_rows"),
            F.lit(n.alone).cast("bigint").alias("alone_rows"),
        )
        for rule, n in run.rules.items()
    ))
    return spark.range(1).select(F.inline(counts))


def silver_rules_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = testbed.trips_from_shipments(spark, sf_dir)
    return quality.rule_report(trips, quality.fence_column(trips, SHIPMENTS), SHIPMENTS)


def silver_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table from raw rows in any order, laid out by source, month and pickup."""
    lake = _landed_lake(spark, sf_dir)
    jobs.bronze_all(spark, lake)
    for source in EVENTS.sources:
        path = lake.bronze(source)
        mixed = scratch_path(spark, "mixed")
        spark.read.parquet(path).repartition(16).write.parquet(mixed)
        overwrite_table(spark.read.parquet(mixed), path)
    jobs.silver(spark, lake, layout="rebalance")
    return jobs.read_silver(spark, lake)


def silver_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.trips_by_source(_silver(spark, sf_dir), EVENTS)


def silver_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.trips_by_month(_silver(spark, sf_dir), EVENTS)


def silver_partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition of the cleaned table, written and read back."""
    path = scratch_path(spark, "all_taxi")
    overwrite_table(
        _silver(spark, sf_dir), path, partition_by=[EVENTS.source], open_partitions=2
    )
    return read_table(spark, path).select(*EVENTS.contract)


def silver_partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of it; the scan leaves the other out."""
    return silver_partition_roundtrip(spark, sf_dir).filter(F.col(EVENTS.source) == "yellow")


# ---------------------------------------------------------------- marts


def gold_avg_total_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.avg_total_by_month(_silver(spark, sf_dir), EVENTS)


def gold_avg_passengers_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.avg_passengers_by_hour(_silver(spark, sf_dir), EVENTS)


def gold_trips_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.trips_by_taxi_type(_silver(spark, sf_dir), EVENTS)


def gold_trips_by_type_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.trips_by_taxi_type(_ship_silver(spark, sf_dir), SHIPMENTS)


def gold_peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top_hours_by_taxi_type(_silver(spark, sf_dir), EVENTS)


def gold_hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four marts' keys and counts from the one-scan rollup."""
    rollup = marts.hourly_rollup(_silver(spark, sf_dir), EVENTS)
    return rollup.select(
        EVENTS.source, "month", "hour", "trips", "amount_n", "passengers_n",
        F.round("amount_sum", 2).alias("amount_sum"),
        F.round("passengers_sum", 2).alias("passengers_sum"),
    )


def gold_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer through its stored table: landing, raw, cleaned, marts."""
    lake = _landed_lake(spark, sf_dir)
    return jobs.run_all(spark, lake).marts["trips_by_taxi_type"]


def gold_one_month_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-month mart from the stored trips of that month's partitions."""
    lake = _landed_lake(spark, sf_dir)
    jobs.bronze_all(spark, lake)
    jobs.silver(spark, lake)
    trips = jobs.read_silver(spark, lake, month=EVENTS.passengers_month)
    return marts.avg_passengers_by_hour(trips, EVENTS)


def _stacked(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Several small tables as one, told apart by the column `name`."""
    parts = [df.withColumn(name, F.lit(key)) for key, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gold_marts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four stored marts after a whole run."""
    return _stacked(jobs.run_all(spark, _landed_lake(spark, sf_dir)).marts, "mart")


def gold_changed_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four marts after May alone was cleaned anew and its rollup replaced."""
    lake = _landed_lake(spark, sf_dir)
    run = jobs.run_all(spark, lake)
    late = [int(EVENTS.period_end[:7].replace("-", ""))]
    jobs.silver(spark, lake, months=late, fence=run.silver.fence)
    return _stacked(jobs.gold(spark, lake, months=late), "mart")


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report set over the stored marts after a whole run."""
    lake = _landed_lake(spark, sf_dir)
    jobs.run_all(spark, lake)
    sets = jobs.report(spark, lake)
    return _stacked({k: v for k, v in sets.items() if k not in marts.MARTS}, "report")


# ---------------------------------------------------------------- reports


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.trips_by_taxi_type(_silver(spark, sf_dir), EVENTS)


def report_month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_table(_by_type(spark, sf_dir), EVENTS)


def report_month_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_table(gold_avg_total_by_month(spark, sf_dir))


def report_hour_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hour_table(gold_avg_passengers_by_hour(spark, sf_dir))


def report_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpis(_by_type(spark, sf_dir), EVENTS)


def report_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.side_by_side(_by_type(spark, sf_dir), EVENTS)


def report_hour_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hour_facets(gold_peak_hours(spark, sf_dir), EVENTS)


def report_source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_slice(_by_type(spark, sf_dir), "green", "month", EVENTS)


def preview_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(gold_peak_hours(spark, sf_dir))


# ---------------------------------------------------------------- training data

# The operators on training data are a subpackage of their own and may be left out.
_LLM: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LLM_SQL: dict[str, str] = {}
try:
    from curbside.llm import queries as llm_queries
except ImportError:
    pass
else:
    _LLM, _LLM_SQL = llm_queries.QUERIES, llm_queries.ORACLE_SQL

# ---------------------------------------------------------------- contract

_QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    bronze_drift_union,
    bronze_missing_month,
    bronze_summary,
    silver_conform,
    trip_duration,
    iqr_fence_exact,
    iqr_fence_approx,
    iqr_fence_shipments,
    silver_clean,
    silver_clean_shipments,
    silver_report,
    silver_rules,
    silver_rules_shipments,
    silver_rebalanced,
    silver_by_type,
    silver_by_month,
    silver_partition_roundtrip,
    silver_partition_pruned,
    gold_avg_total_by_month,
    gold_avg_passengers_by_hour,
    gold_trips_by_type,
    gold_trips_by_type_shipments,
    gold_peak_hours,
    gold_hourly_rollup,
    gold_roundtrip,
    gold_one_month_stored,
    gold_marts_roundtrip,
    gold_changed_month,
    report_roundtrip,
    report_month_labels,
    report_month_table,
    report_hour_table,
    report_kpis,
    report_side_by_side,
    report_hour_facets,
    report_source_slice,
    preview_top20,
]


def entry(spark: SparkSession) -> DataFrame:
    """Trips, ticket and passengers per source and month at the smallest scale."""
    return gold_trips_by_type(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES} | _LLM


def _feed(trips_sql: str, period: tuple[str, str]) -> str:
    """CTEs `trips`, `population`, `fence` and `silver` over one feed."""
    start, end = period
    return f"""
    WITH trips AS ({trips_sql}),
    timed AS (
        SELECT *, (epoch_us(dropoff_ts) // 1000000 - epoch_us(pickup_ts) // 1000000) / 3600
                  AS hours
        FROM trips),
    population AS (
        SELECT hours FROM timed
        WHERE pickup_ts >= TIMESTAMP '{start}' AND pickup_ts <= TIMESTAMP '{end}'
          AND dropoff_ts > pickup_ts),
    quartiles AS (
        SELECT quantile_disc(hours, 0.25) AS p25, quantile_disc(hours, 0.75) AS p75
        FROM population),
    fence AS (SELECT p25, p75, p75 + 1.5 * (p75 - p25) AS fence FROM quartiles),
    silver AS (
        SELECT vendor_id, passenger_count, total_amount, pickup_ts, dropoff_ts, taxi_type
        FROM timed, fence
        WHERE pickup_ts >= TIMESTAMP '{start}' AND pickup_ts <= TIMESTAMP '{end}'
          AND passenger_count > 0 AND total_amount >= 0 AND total_amount < 10000
          AND dropoff_ts > pickup_ts AND hours <= fence)
    """


def _rules(feed: str, period: tuple[str, str]) -> str:
    start, end = period
    broken = {
        "period": f"pickup_ts >= TIMESTAMP '{start}' AND pickup_ts <= TIMESTAMP '{end}'",
        "passengers": "passenger_count > 0",
        "amount": "total_amount >= 0 AND total_amount < 10000",
        "times": "pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL",
        "direction": "dropoff_ts > pickup_ts",
        "duration": "hours <= fence",
    }
    flags = ", ".join(
        f"CASE WHEN {rule} THEN 0 ELSE 1 END AS b_{name}" for name, rule in broken.items()
    )
    number = " + ".join(f"b_{name}" for name in broken)
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (b_{name} = 1) AS broken_rows, "
        f"count(*) FILTER (b_{name} = 1 AND {number} = 1) AS alone_rows FROM flags"
        for name in broken
    )
    return f"{feed}, flags AS (SELECT {flags} FROM timed, fence) {rows}"


def oracle_sql() -> dict[str, str]:
    ev = _feed(EVENTS_SQL, (EVENTS.period_start, EVENTS.period_end))
    ship = _feed(SHIPMENTS_SQL, (SHIPMENTS.period_start, SHIPMENTS.period_end))
    by_type = """
        SELECT taxi_type, CAST(month(pickup_ts) AS INTEGER) AS month,
               count(*) AS total_corridas, round(avg(total_amount), 2) AS avg_total_amount,
               round(avg(passenger_count), 2) AS avg_passengers
        FROM silver GROUP BY 1, 2
    """
    by_month = """
        SELECT CAST(month(pickup_ts) AS INTEGER) AS month,
               round(avg(total_amount), 2) AS avg_total_amount, count(*) AS total_corridas
        FROM silver WHERE taxi_type = 'yellow' GROUP BY 1
    """
    by_hour = """
        SELECT CAST(hour(pickup_ts) AS INTEGER) AS hour,
               round(avg(passenger_count), 2) AS avg_passengers, count(*) AS total_corridas
        FROM silver WHERE month(pickup_ts) = 5 GROUP BY 1
    """
    peaks = """
        SELECT taxi_type, CAST(hour(pickup_ts) AS INTEGER) AS hour, count(*) AS total_corridas
        FROM silver GROUP BY 1, 2
    """
    label = """CASE month WHEN 1 THEN 'Jan' WHEN 2 THEN 'Fev' WHEN 3 THEN 'Mar'
                          WHEN 4 THEN 'Abr' WHEN 5 THEN 'Mai' END"""
    drifted = f"""
        WITH trips AS ({EVENTS_SQL}),
        raw AS (
            SELECT vendor_id, passenger_count, total_amount, taxi_type, pickup_ts, dropoff_ts,
                   CASE WHEN month(pickup_ts) % 2 = 0 THEN total_amount / 100 END AS airport_fee
            FROM trips)
        SELECT vendor_id, passenger_count, total_amount, airport_fee, taxi_type,
               CASE WHEN taxi_type = 'yellow' THEN pickup_ts END AS tpep_pickup_datetime,
               CASE WHEN taxi_type = 'yellow' THEN dropoff_ts END AS tpep_dropoff_datetime,
               CASE WHEN taxi_type = 'green' THEN pickup_ts END AS lpep_pickup_datetime,
               CASE WHEN taxi_type = 'green' THEN dropoff_ts END AS lpep_dropoff_datetime
        FROM raw
    """
    contract = "vendor_id, passenger_count, total_amount, pickup_ts, dropoff_ts, taxi_type"
    marts_sql = ev + f"""
        , by_type AS ({by_type}), by_month AS ({by_month}), by_hour AS ({by_hour}),
        peaks AS ({peaks})
        SELECT 'trips_by_taxi_type' AS mart, * FROM by_type
        UNION ALL BY NAME SELECT 'avg_total_by_month' AS mart, * FROM by_month
        UNION ALL BY NAME SELECT 'avg_passengers_by_hour' AS mart, * FROM by_hour
        UNION ALL BY NAME SELECT 'top_hours_by_taxi_type' AS mart, * FROM peaks
    """
    return {
        "bronze_drift_union": drifted,
        "bronze_missing_month": drifted,
        "bronze_summary": f"""
            WITH trips AS ({EVENTS_SQL})
            SELECT CASE WHEN grouping(taxi_type) = 1 THEN 'TOTAL' ELSE taxi_type END AS taxi_type,
                   count(*) AS total_corridas
            FROM trips GROUP BY ROLLUP (taxi_type)
        """,
        "silver_conform": f"""
            WITH trips AS ({EVENTS_SQL})
            SELECT {contract} FROM trips WHERE taxi_type = 'yellow'
            UNION ALL
            SELECT {contract} FROM trips WHERE taxi_type = 'green'
        """,
        "trip_duration": ev + "SELECT vendor_id, pickup_ts, dropoff_ts, hours FROM timed",
        "iqr_fence_exact": ev + "SELECT p25, p75, fence FROM fence",
        "iqr_fence_approx": ev + """
            SELECT share, count(*) AS size, true AS within
            FROM population, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) AS q(share)
            GROUP BY share
        """,
        "iqr_fence_shipments": ship + "SELECT p25, p75, fence FROM fence",
        "silver_clean": ev + f"SELECT {contract} FROM silver",
        "silver_clean_shipments": ship + f"SELECT {contract} FROM silver",
        "silver_report": ev + """
            SELECT raw_rows, clean_rows, raw_rows - clean_rows AS removed_rows,
                   round((raw_rows - clean_rows) / raw_rows * 100, 1) AS removed_pct
            FROM (SELECT count(*) AS raw_rows FROM trips),
                 (SELECT count(*) AS clean_rows FROM silver)
        """,
        "silver_rules": _rules(ev, (EVENTS.period_start, EVENTS.period_end)),
        "silver_rules_shipments": _rules(ship, (SHIPMENTS.period_start, SHIPMENTS.period_end)),
        "silver_rebalanced": ev + f"SELECT {contract} FROM silver",
        "silver_by_type": ev + """
            SELECT taxi_type, count(*) AS total_corridas FROM silver
            GROUP BY taxi_type ORDER BY taxi_type
        """,
        "silver_by_month": ev + """
            SELECT CAST(month(pickup_ts) AS INTEGER) AS month, count(*) AS total_corridas
            FROM silver GROUP BY 1 ORDER BY 1
        """,
        "silver_partition_roundtrip": ev + f"SELECT {contract} FROM silver",
        "silver_partition_pruned": ev
        + f"SELECT {contract} FROM silver WHERE taxi_type = 'yellow'",
        "gold_avg_total_by_month": ev + by_month + "ORDER BY month",
        "gold_avg_passengers_by_hour": ev + by_hour + "ORDER BY hour",
        "gold_one_month_stored": ev + by_hour + "ORDER BY hour",
        "gold_trips_by_type": ev + by_type + "ORDER BY taxi_type, month",
        "gold_trips_by_type_shipments": ship + by_type + "ORDER BY taxi_type, month",
        "gold_peak_hours": ev + peaks + "ORDER BY taxi_type, total_corridas DESC, hour",
        "gold_hourly_rollup": ev + """
            SELECT taxi_type, CAST(month(pickup_ts) AS INTEGER) AS month,
                   CAST(hour(pickup_ts) AS INTEGER) AS hour, count(*) AS trips,
                   count(total_amount) AS amount_n, count(passenger_count) AS passengers_n,
                   round(sum(total_amount), 2) AS amount_sum,
                   round(sum(passenger_count), 2) AS passengers_sum
            FROM silver GROUP BY 1, 2, 3
        """,
        "gold_roundtrip": ev + by_type + "ORDER BY taxi_type, month",
        "gold_marts_roundtrip": marts_sql,
        "gold_changed_month": marts_sql,
        "report_roundtrip": ev + f"""
            , by_type AS ({by_type}), by_month AS ({by_month}), by_hour AS ({by_hour}),
            peaks AS ({peaks})
            SELECT 'month_table' AS report, {label} AS "Mês",
                   avg_total_amount AS "Média (USD)", total_corridas AS "Total corridas"
            FROM by_month
            UNION ALL BY NAME
            SELECT 'hour_table' AS report, hour AS "Hora",
                   avg_passengers AS "Média passageiros", total_corridas AS "Total corridas"
            FROM by_hour
            UNION ALL BY NAME
            SELECT 'type_table' AS report, taxi_type, {label} AS mes_nome, total_corridas,
                   avg_total_amount, avg_passengers
            FROM by_type
            UNION ALL BY NAME
            SELECT 'kpis' AS report, taxi_type,
                   CAST(sum(total_corridas) AS BIGINT) AS total_corridas,
                   round(avg(avg_total_amount), 2) AS ticket_medio
            FROM by_type GROUP BY taxi_type
            UNION ALL BY NAME
            SELECT 'side_by_side' AS report, month, {label} AS mes_nome,
                   max(total_corridas) FILTER (taxi_type = 'yellow') AS yellow_total_corridas,
                   max(avg_total_amount) FILTER (taxi_type = 'yellow') AS yellow_avg_total_amount,
                   max(total_corridas) FILTER (taxi_type = 'green') AS green_total_corridas,
                   max(avg_total_amount) FILTER (taxi_type = 'green') AS green_avg_total_amount
            FROM by_type GROUP BY month
            UNION ALL BY NAME
            SELECT 'hour_facets' AS report, taxi_type, hour, total_corridas FROM peaks
        """,
        "report_month_labels": ev + f"""
            , by_type AS ({by_type})
            SELECT taxi_type, {label} AS mes_nome, total_corridas, avg_total_amount,
                   avg_passengers
            FROM by_type ORDER BY taxi_type, month
        """,
        "report_month_table": ev + f"""
            , by_month AS ({by_month})
            SELECT {label} AS "Mês", avg_total_amount AS "Média (USD)",
                   total_corridas AS "Total corridas"
            FROM by_month ORDER BY month
        """,
        "report_hour_table": ev + f"""
            , by_hour AS ({by_hour})
            SELECT hour AS "Hora", avg_passengers AS "Média passageiros",
                   total_corridas AS "Total corridas"
            FROM by_hour ORDER BY hour
        """,
        "report_kpis": ev + f"""
            , by_type AS ({by_type})
            SELECT taxi_type, CAST(sum(total_corridas) AS BIGINT) AS total_corridas,
                   round(avg(avg_total_amount), 2) AS ticket_medio
            FROM by_type GROUP BY taxi_type ORDER BY taxi_type
        """,
        "report_side_by_side": ev + f"""
            , by_type AS ({by_type})
            SELECT month, {label} AS mes_nome,
                   max(total_corridas) FILTER (taxi_type = 'yellow') AS yellow_total_corridas,
                   max(avg_total_amount) FILTER (taxi_type = 'yellow') AS yellow_avg_total_amount,
                   max(total_corridas) FILTER (taxi_type = 'green') AS green_total_corridas,
                   max(avg_total_amount) FILTER (taxi_type = 'green') AS green_avg_total_amount
            FROM by_type GROUP BY month ORDER BY month
        """,
        "report_hour_facets": ev + f"""
            , peaks AS ({peaks})
            SELECT taxi_type, hour, total_corridas FROM peaks ORDER BY taxi_type, hour
        """,
        "report_source_slice": ev + f"""
            , by_type AS ({by_type})
            SELECT * FROM by_type WHERE taxi_type = 'green' ORDER BY month
        """,
        "preview_top20": ev + peaks + """
            ORDER BY taxi_type, total_corridas DESC, hour LIMIT 20
        """,
    } | _LLM_SQL
