"""Quantiles of a whole-number column without a single-task bottleneck.

Spark's own quantile aggregates are global: each input task ships its sketch
(`percentile_approx`) or its map of distinct values (`percentile_disc`) to one
reducer, which merges all of them. With hundreds of thousands of input tasks that
one reducer is the whole job. Here

* the exact quantiles come from a sketch that only brackets the wanted ranks, buckets of
  values with their counts, and from counts inside the brackets. Counts combine map-side and
  spread over the shuffle. Small values have a bucket each, so mostly the sketch is the answer;
* the approximate ones merge KLL sketches in stages, so the last task merges a fixed number.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sketches that each stage of merges leaves, before the last one.
MERGES = (4096, 64)


@dataclass(frozen=True)
class Bracket:
    """The values `low` to `high` hold the wanted rank; `before` rows are below them."""

    name: str
    rank: int
    before: int
    low: int
    high: int


def _shift(value: Column, level_bits: int) -> Column:
    """Bits that a value's bucket is wide: none for small values, so that they stand alone,
    and in steps more for larger ones, so that no class has many buckets."""
    size = F.greatest(value, F.bitwise_not(value))  # the magnitude; negatives count from -1
    step = min(8, level_bits - 5)  # a class begins at a multiple of its buckets' width
    width, shift = F.when(size < 1 << (level_bits - 2), 0), step
    while level_bits - 5 + shift < 63:
        width = width.when(size < 1 << (level_bits - 5 + shift), shift)
        shift += step
    return width.otherwise(shift)


def sketch(df: DataFrame, value: Column, level_bits: int) -> DataFrame:
    """low, shift, n: buckets of values and their rows, 2 ** `level_bits` buckets at most.
    Sketches of parts merge by adding counts, which is what the aggregate does."""
    values = df.select(value.cast("bigint").alias("v")).filter("v IS NOT NULL")
    shift = F.col("shift")
    return (
        values.withColumn("shift", _shift(F.col("v"), level_bits))
        .groupBy(F.call_function("shiftright", "v", shift).alias("bucket"), "shift")
        .agg(F.count("*").alias("n"))
        .select(F.call_function("shiftleft", "bucket", shift).alias("low"), "shift", "n")
    )


def _bracket(buckets: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """The bucket of each wanted rank. All buckets are ordered in one task: their number is
    bounded."""
    ordered, every = Window.orderBy("low"), Window.orderBy("low").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            # In decimals: as doubles, 0.07 of 100 is a little more than 7.
            F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(Decimal(str(p)))))
            .cast("bigint").alias("rank"),
        )
        for name, p in probs.items()
    ])
    upto = F.sum("n").over(ordered)
    return (
        buckets.select("low", "shift", "n", upto.alias("upto"), F.sum("n").over(every).alias("total"))
        .withColumn("before", F.col("upto") - F.col("n"))
        .select("low", "shift", "before", "upto", F.explode(wanted).alias("want"))
        .filter("before < want.rank AND want.rank <= upto")
        .select("want.name", "want.rank", "before", "low", "shift")
    )


def inside(
    df: DataFrame, value: Column, brackets: list[Bracket], level_bits: int
) -> DataFrame:
    """As `_bracket`, with the buckets into which the brackets are cut. At most
    2 ** `level_bits` buckets a bracket are ordered in one task."""
    values = df.select(value.cast("bigint").alias("v"))
    open_ = F.array(*[
        F.struct(
            F.lit(b.name).alias("name"), F.lit(b.rank).cast("bigint").alias("rank"),
            F.lit(b.before).cast("bigint").alias("base"), F.lit(b.low).cast("bigint").alias("low"),
            F.lit(b.high).cast("bigint").alias("high"),
            F.lit(max(0, (b.high - b.low).bit_length() - level_bits)).alias("shift"),
        )
        for b in brackets
    ])
    mine = F.filter(open_, lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"]))
    bucket = F.call_function("shiftright", F.col("v") - F.col("b.low"), F.col("b.shift"))
    counts = (
        values.select("v", F.explode(mine).alias("b"))
        .groupBy("b", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select("b.*", "bucket", "n")
    )
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("name").orderBy("bucket"))
    return (
        counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        .filter("before < rank AND rank <= upto")
        .selectExpr("name", "rank", "before", "low + shiftleft(bucket, shift) AS low", "shift")
    )


def discrete_quantiles(
    df: DataFrame, value: Column, probs: Mapping[str, float], level_bits: int = 23
) -> DataFrame:
    """One row with, per name in `probs`, the smallest observed `value` whose
    cumulative share of the rows reaches that probability.

    `value` must be integral; null values are ignored. Without any value the row
    holds nulls. The row is computed here, by one job over `df`, and by further ones only
    for values beyond 2 ** (`level_bits` - 2), whose buckets hold several. Each job gives
    the driver one row a probability, and orders at most 2 ** `level_bits` buckets in a task
    (`level_bits` a probability, after the first job).
    """
    if not 12 <= level_bits <= 30:
        raise ValueError("level_bits must be from 12 to 30")
    found: dict[str, int | None] = dict.fromkeys(probs)
    level = _bracket(sketch(df, value, level_bits), probs)
    while True:
        brackets = [
            Bracket(r["name"], r["rank"], r["before"], r["low"], r["low"] + (1 << r["shift"]) - 1)
            for r in level.collect()  # a row for each probability
        ]
        found |= {b.name: b.low for b in brackets}
        brackets = [b for b in brackets if b.high > b.low]
        if not brackets:
            break
        level = inside(df, value, brackets, level_bits)
    row = pa.table({name: pa.array([v], pa.int64()) for name, v in found.items()})
    return df.sparkSession.createDataFrame(row)


def kll_size(accuracy: int) -> int:
    """Size of a KLL sketch whose ranks are off by at most 1 / `accuracy`, 99 times in 100.
    The largest one that there is serves about 9,600."""
    # The published fit of the sketch's single-sided error.
    return min(65535, max(8, math.ceil((2.296 * accuracy) ** (1 / 0.9021))))


def approximate_quantiles(
    df: DataFrame, value: Column, probs: Mapping[str, float], accuracy: int
) -> DataFrame:
    """One row with an observed value per name in `probs`, whose rank is off by at most a
    share of 1 / `accuracy` (see `kll_size`). Without any value the row holds nulls.

    Every task's sketch goes to one of 4096 merges, those to one of 64, and those to the
    last: no task merges a number of sketches that grows with the input's square root.
    """
    values = df.select(value.cast("bigint").alias("v"))
    merged = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES[0])).alias("part")).agg(
        F.kll_sketch_agg_bigint("v", kll_size(accuracy)).alias("s")
    )
    for parts in MERGES[1:]:
        merged = merged.groupBy(F.pmod("part", F.lit(parts)).alias("part")).agg(
            F.kll_merge_agg_bigint("s").alias("s")
        )
    whole = merged.agg(F.kll_merge_agg_bigint("s").alias("s"))
    some = F.kll_sketch_get_n_bigint("s") > 0
    return whole.select(*(
        F.when(some, F.kll_sketch_get_quantile_bigint("s", F.lit(float(p)))).alias(name)
        for name, p in probs.items()
    ))
