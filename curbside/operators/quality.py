"""Quality rules: the duration fence, the cleaning filter and its report."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.quantiles import approximate_quantiles, discrete_quantiles
from curbside.functions.time import duration_hours, duration_seconds
from curbside.spec import DEFAULT_SPEC, MONTH, TOTAL_LABEL, TRIPS, TripSpec


class EmptyPopulationError(ValueError):
    """There is no trip to compute the fence from."""


def in_period(spec: TripSpec = DEFAULT_SPEC) -> Column:
    """Picked up inside the period, both ends included."""
    pickup = F.col(spec.pickup)
    return (pickup >= F.lit(spec.period_start)) & (pickup <= F.lit(spec.period_end))


def runs_forward(spec: TripSpec = DEFAULT_SPEC) -> Column:
    """Ends after it starts, at full timestamp resolution."""
    return F.col(spec.dropoff) > F.col(spec.pickup)


def fence_population(df: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """The trips the fence is computed from: in the period and running forward.
    The other quality rules deliberately do not apply here."""
    return df.filter(in_period(spec) & runs_forward(spec))


def fence_stats(
    df: DataFrame,
    spec: TripSpec = DEFAULT_SPEC,
    method: str = "exact",
    accuracy: int = 10000,
) -> DataFrame:
    """One row: the duration quartiles `p25`, `p75` and the upper `fence`, in hours.

    `fence = p75 + factor * (p75 - p25)`. Both methods return observed durations.

    * ``exact``: the smallest duration whose cumulative share reaches the quartile, found
      by a job that runs here. The result does not depend on how rows are spread over
      tasks, so a rerun or a lost executor cannot move the fence, and no single task
      merges the input.
    * ``approx``: KLL sketches merged in stages, rank error 1 / `accuracy` (see
      `approximate_quantiles`). Nothing runs before the row is asked for.
    """
    population, shares = fence_population(df, spec), {"p25": 0.25, "p75": 0.75}
    if method == "exact":
        quartiles = discrete_quantiles(population, duration_seconds(spec), shares)
    elif method == "approx":
        quartiles = approximate_quantiles(population, duration_seconds(spec), shares, accuracy)
    else:
        raise ValueError(f"unknown quartile method: {method!r}")
    quartiles = quartiles.select(*((F.col(name) / 3600).alias(name) for name in shares))
    fence = F.col("p75") + F.lit(spec.fence_factor) * (F.col("p75") - F.col("p25"))
    return quartiles.withColumn("fence", fence)


def fence_column(df: DataFrame, spec: TripSpec = DEFAULT_SPEC, **how) -> Column:
    """The fence for use inside a larger plan: a number found by a job that runs here, null
    if there is no trip to compute it from."""
    return F.lit(fence_stats(df, spec, **how).first()["fence"]).cast("double")


def iqr_fence(df: DataFrame, spec: TripSpec = DEFAULT_SPEC, **how) -> float:
    """The fence as a number."""
    fence = fence_stats(df, spec, **how).first()["fence"]
    if fence is None:
        raise EmptyPopulationError(
            f"no forward-running trip between {spec.period_start} and {spec.period_end}"
        )
    return fence


def rules(fence: float | Column, spec: TripSpec = DEFAULT_SPEC) -> dict[str, Column]:
    """The quality rules by name. `fence` (hours) is inclusive.

    A null in a tested column makes its rule null, which removes the row. NaN sorts
    above every number, so a NaN passenger count passes and a NaN amount does not.
    """
    passengers, amount = F.col(spec.passengers), F.col(spec.amount)
    limit = fence if isinstance(fence, Column) else F.lit(float(fence))
    return {
        "period": in_period(spec),
        "passengers": passengers.isNotNull() & (passengers > 0),
        "amount": amount.isNotNull() & (amount >= 0) & (amount < spec.amount_limit),
        "times": F.col(spec.pickup).isNotNull() & F.col(spec.dropoff).isNotNull(),
        "direction": runs_forward(spec),
        "duration": duration_hours(spec) <= limit,
    }


def is_clean(fence: float | Column, spec: TripSpec = DEFAULT_SPEC) -> Column:
    """All quality rules in one predicate."""
    return reduce(and_, rules(fence, spec).values())


def clean(df: DataFrame, fence: float | Column, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """The trips that satisfy every rule; columns are those of `df`."""
    return df.filter(is_clean(fence, spec))


def cleaning_report(
    df: DataFrame, fence: float | Column, spec: TripSpec = DEFAULT_SPEC
) -> DataFrame:
    """One row, one pass: rows before, rows kept, rows removed and the percentage
    removed (null for an empty input)."""
    counts = df.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(is_clean(fence, spec)).alias("clean_rows"),
    )
    removed = F.col("raw_rows") - F.col("clean_rows")
    return counts.select(
        "raw_rows",
        "clean_rows",
        removed.alias("removed_rows"),
        F.round(F.try_divide(removed, F.col("raw_rows")) * 100, 1).alias("removed_pct"),
    )


def rule_counts(fence: float | Column, spec: TripSpec = DEFAULT_SPEC) -> list[Column]:
    """Aggregates over raw trips: raw_rows, clean_rows, and per rule the rows that break it
    (`<rule>_broken`; a null counts as broken) and those that break no other (`<rule>_alone`)."""
    broken = {
        name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules(fence, spec).items()
    }
    number = reduce(add, (b.cast("int") for b in broken.values()))
    return [
        F.count("*").alias("raw_rows"),
        F.count_if(number == 0).alias("clean_rows"),
        *(F.count_if(b).alias(f"{name}_broken") for name, b in broken.items()),
        *(F.count_if(b & (number == 1)).alias(f"{name}_alone") for name, b in broken.items()),
    ]


def rule_report(
    df: DataFrame, fence: float | Column, spec: TripSpec = DEFAULT_SPEC
) -> DataFrame:
    """One row per rule, from one pass: rule, broken_rows, alone_rows."""
    names = rules(0.0, spec)
    rows = F.array(*(
        F.struct(
            F.lit(name).alias("rule"), F.col(f"{name}_broken").alias("broken_rows"),
            F.col(f"{name}_alone").alias("alone_rows"),
        )
        for name in names
    ))
    return df.agg(*rule_counts(fence, spec)).select(F.inline(rows))


def trips_by_source(df: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows per source."""
    return df.groupBy(spec.source).agg(F.count("*").alias(TRIPS)).orderBy(spec.source)


def trips_by_month(df: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows per month of the year."""
    month = F.month(spec.pickup).alias(MONTH)
    return df.groupBy(month).agg(F.count("*").alias(TRIPS)).orderBy(MONTH)


def ingest_summary(df: DataFrame, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows per source and a grand total labelled `TOTAL`.

    The rollup runs over the per-source counts: rolling up the rows themselves
    would double every row before it is counted.
    """
    per_source = df.groupBy(spec.source).agg(F.count("*").alias("n"))
    totals = per_source.rollup(spec.source).agg(
        F.sum("n").alias(TRIPS), F.grouping(spec.source).alias("is_total")
    )
    label = F.when(F.col("is_total") == 1, TOTAL_LABEL).otherwise(F.col(spec.source))
    return totals.orderBy("is_total", spec.source).select(label.alias(spec.source), TRIPS)
