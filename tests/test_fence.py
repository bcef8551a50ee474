"""Quartiles and the duration fence."""

import math
import random
from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import frame, trip

from curbside.functions import discrete_quantiles, duration_hours, quantiles
from curbside.operators.quality import (
    EmptyPopulationError,
    clean,
    fence_stats,
    iqr_fence,
    fence_column,
)
from curbside.spec import DEFAULT_SPEC
from curbside.testbed import EVENTS, SHIPMENTS, trips_from_events, trips_from_shipments


def observed(values, p):
    """The smallest value with at least a share p of the values at or below it."""
    ranked = sorted(values)
    return ranked[max(1, math.ceil(len(ranked) * Decimal(str(p)))) - 1]


def test_ranks_are_decimal(spark):
    """As doubles, 0.07 of 100 is a little more than 7."""
    found = discrete_quantiles(spark.range(1, 101), F.col("id"), {"x": 0.07}).first()
    assert found.x == 7


VALUES = {
    "one": [7],
    "two": [3, 9],
    "same": [5] * 50,
    "zeros": [0, 0, 0, 1],
    "signs": [-900, -5, -1, 0, 1, 2, 1000],
    "third of rows equal": [600] * 400 + list(range(800)),
    "uniform": [random.Random(1).randrange(10**6) for _ in range(3000)],
    "log spread": [int(math.exp(random.Random(i).uniform(0, 40))) for i in range(3000)],
    "both signs, log spread": [
        (-1) ** i * int(math.exp(random.Random(i).uniform(0, 43))) for i in range(2000)
    ],
    "largest": [2**63 - 1, -(2**63) + 1, 0],
}
PROBS = {"lowest": 0.0, "p10": 0.1, "p25": 0.25, "mid": 0.5, "p75": 0.75, "p99": 0.99, "top": 1.0}


@pytest.mark.parametrize("name", VALUES)
def test_quantiles_equal_brute_force(spark, name):
    values = VALUES[name]
    rows = [(v,) for v in values] + [(None,)]
    df = spark.createDataFrame(rows, "x bigint").repartition(5)
    got = discrete_quantiles(df, F.col("x"), PROBS).first().asDict()
    assert got == {key: observed(values, p) for key, p in PROBS.items()}


@pytest.mark.parametrize("level_bits", [23, 16, 12])
@pytest.mark.parametrize("name", ["both signs, log spread", "largest", "signs"])
def test_levels_do_not_change_the_result(spark, name, level_bits):
    values = VALUES[name]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    got = discrete_quantiles(df, F.col("x"), PROBS, level_bits).first().asDict()
    assert got == {key: observed(values, p) for key, p in PROBS.items()}


def test_buckets_lie_apart_and_hold_their_values(spark):
    """Around every limit of a class of buckets, on both sides of zero."""
    limits = [0, *(2**k for k in range(1, 63)), 2**63 - 1]
    values = sorted({s * v + d for v in limits for s in (1, -1) for d in (-1, 0, 1)})
    values = [v for v in values if -(2**63) <= v < 2**63]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    for level_bits in (12, 14, 23):
        rows = quantiles.sketch(df, F.col("x"), level_bits).orderBy("low").collect()
        ends = [r.low + 2**r.shift for r in rows]
        assert all(end <= after.low for end, after in zip(ends, rows[1:]))
        for row, end in zip(rows, ends):
            assert row.n == sum(row.low <= v < end for v in values)
        assert sum(r.n for r in rows) == len(values)
        alone = 2 ** (level_bits - 2)
        assert all(r.shift == 0 for r in rows if -alone <= r.low < alone)


@pytest.fixture
def levels(monkeypatch):
    """The plans of all levels of a descent."""
    made = []
    for name in ("_bracket", "inside"):
        real = getattr(quantiles, name)

        def record(*args, real=real):
            made.append(real(*args))
            return made[-1]

        monkeypatch.setattr(quantiles, name, record)
    return made


def _ordered_rows(df):
    """Rows that reached each window of an executed plan."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "WindowExec":
            stage = node
            while not stage.getClass().getSimpleName().startswith("ShuffleQueryStage"):
                stage = stage.children().apply(0)
            rows.append(stage.getRuntimeStatistics().rowCount().get())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_clustered_values_are_not_ordered_in_one_task(spark, levels):
    """200,000 epoch seconds in a row: no window orders all of them."""
    start = 1_700_000_000
    df = discrete_quantiles(
        spark.range(start, start + 200_000), F.col("id"), {"a": 0.25, "b": 0.75}, 12
    )
    assert tuple(df.collect()[0]) == (start + 49_999, start + 149_999)
    ordered = [rows for level in levels for rows in _ordered_rows(level)]
    assert len(levels) >= 2 and len(ordered) >= 3 and max(ordered) <= 2 * 2**12


def test_durations_of_days_take_one_level(spark, levels):
    df = spark.range(100_000).select((F.col("id") * 37 % 2_000_000).alias("x"))
    assert discrete_quantiles(df, F.col("x"), {"a": 0.5}).first().a is not None
    assert len(levels) == 1


def test_approximate_merges_are_bounded(spark):
    """300 tasks: the last merge sees at most as many sketches as the stage before leaves."""
    df = spark.range(0, 60_000, 1, 300)
    found = quantiles.approximate_quantiles(df, F.col("id"), {"a": 0.25, "b": 0.75}, 1000)
    assert all(abs(v / 60_000 - p) <= 1 / 1000 for v, p in zip(found.first(), (0.25, 0.75)))
    found.collect()
    rows = _shuffled_rows(found)
    assert len(rows) == 3 and rows[0] <= 64 and rows[1] <= 4096 and rows[2] == 300


def _shuffled_rows(df):
    """Rows of each exchange of an executed plan, last first."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop(0)
        kind = node.getClass().getSimpleName()
        if kind.startswith("ShuffleQueryStage"):
            rows.append(node.getRuntimeStatistics().rowCount().get())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_sketch_sizes():
    assert quantiles.kll_size(1) == 8
    assert quantiles.kll_size(100) < quantiles.kll_size(1000) < quantiles.kll_size(10**6) == 65535


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_nothing_has_no_quartiles(spark, method):
    assert tuple(fence_stats(frame(spark, []), method=method).first()) == (None, None, None)


@settings(max_examples=8, deadline=None, derandomize=True)
@given(st.lists(st.integers(-(2**63) + 1, 2**63 - 1) | st.integers(-50, 50), min_size=1))
def test_quantiles_of_any_numbers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    got = discrete_quantiles(df, F.col("x"), PROBS).first().asDict()
    assert got == {key: observed(values, p) for key, p in PROBS.items()}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x bigint")
    assert tuple(discrete_quantiles(df, F.col("x"), {"a": 0.5}).first()) == (None,)


def test_quantiles_equal_the_builtin(spark, sf_check):
    trips = trips_from_shipments(spark, sf_check)
    ours = fence_stats(trips, SHIPMENTS).first()
    builtin = (
        trips.filter("pickup_ts >= '1995-02-01' and pickup_ts <= '1995-05-31'")
        .filter("dropoff_ts > pickup_ts")
        .select(duration_hours(SHIPMENTS).alias("h"))
        .selectExpr(
            "percentile_disc(0.25) within group (order by h) as p25",
            "percentile_disc(0.75) within group (order by h) as p75",
        )
        .first()
    )
    assert (ours.p25, ours.p75) == (builtin.p25, builtin.p75)


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_fence_value(spark, method):
    start = datetime(2023, 1, 1, 8)
    df = frame(spark, [trip(pickup=start, minutes=m) for m in (10, 20, 30, 60)])
    row = fence_stats(df, method=method).first()
    assert (row.p25, row.p75, row.fence) == (1 / 6, 0.5, 1.0)
    assert iqr_fence(df, method=method) == 1.0 > row.p75


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_fence_of_three(spark, method):
    df = frame(spark, [trip(minutes=m) for m in (15, 30, 45)])
    assert iqr_fence(df, method=method) == 0.75 + 1.5 * 0.5


def test_population_ignores_the_other_rules(spark):
    """Only the period and the direction count; passengers and amount do not."""
    good = [trip(minutes=m) for m in (10, 20, 30, 60)]
    outside = [trip(pickup=datetime(2023, 6, 1), minutes=600), trip(minutes=-600)]
    assert iqr_fence(frame(spark, good + outside)) == 1.0
    dirty = [trip(minutes=m, passengers=None, amount=-1.0) for m in (300, 400, 500, 600)]
    assert iqr_fence(frame(spark, good + dirty)) > 5


def test_nothing_to_measure(spark):
    df = frame(spark, [trip(minutes=-5)])
    with pytest.raises(EmptyPopulationError, match="2023-01-01"):
        iqr_fence(df)
    assert clean(df, fence_column(df)).count() == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="guess"):
        iqr_fence(frame(spark, [trip()]), method="guess")


def test_lazy_and_eager_agree(spark, sf_small):
    trips = trips_from_events(spark, sf_small)
    eager = clean(trips, iqr_fence(trips, EVENTS), EVENTS)
    lazy = clean(trips, fence_column(trips, EVENTS), EVENTS)
    assert eager.count() == lazy.count() == 545


def test_exact_fence_does_not_depend_on_partitioning(spark, sf_check):
    trips = trips_from_events(spark, sf_check)
    fences = {iqr_fence(trips.repartition(n), EVENTS) for n in (1, 3, 16)}
    assert fences == {2.521111111111111}


def test_approximation_stays_within_its_rank_error(spark, sf_check):
    trips = trips_from_shipments(spark, sf_check)
    for accuracy in (100, 10000):
        row = fence_stats(trips, SHIPMENTS, "approx", accuracy).first()
        hours = trips.filter("pickup_ts >= '1995-02-01' and pickup_ts <= '1995-05-31'").filter(
            "dropoff_ts > pickup_ts"
        ).select(duration_hours(SHIPMENTS).alias("h"))
        below, upto, total = hours.agg(
            F.count_if(F.col("h") < row.p75), F.count_if(F.col("h") <= row.p75), F.count("*")
        ).first()
        slack = 2 / accuracy
        assert below / total - slack <= 0.75 <= upto / total + slack


def test_zone_moves_zoned_times_only(spark, conf):
    """01:30 to 03:30 on the night clocks go forward."""
    conf("spark.sql.session.timeZone", "America/New_York")
    literals = spark.sql("select 1L as VendorID, '2023-03-12 01:30' as a, '2023-03-12 03:30' as b")
    hours = {}
    for flavour in (T.TimestampType(), T.TimestampNTZType()):
        df = literals.select(
            F.col("a").cast(flavour).alias(DEFAULT_SPEC.pickup),
            F.col("b").cast(flavour).alias(DEFAULT_SPEC.dropoff),
        )
        hours[type(flavour)] = df.select(duration_hours(DEFAULT_SPEC)).first()[0]
    assert hours == {T.TimestampType: 1.0, T.TimestampNTZType: 2.0}
