"""Every registered query against its SQL in DuckDB."""

import os
import subprocess
import sys

import pytest
from compare import duck, duck_result, spark_result

import __spark_entry__ as entry
from curbside import testbed
from curbside.operators import quality

# The queries on training data are tested with their subpackage.
QUERIES = {name: q for name, q in entry.queries().items() if name not in entry._LLM}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(sf_check):
    return duck(sf_check)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, con, sf_check, name):
    df = QUERIES[name](spark, sf_check)
    ours, theirs = spark_result(df), duck_result(con, ORACLES[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_approximation_is_near(spark, sf_check):
    exact = QUERIES["iqr_fence_exact"](spark, sf_check).first()
    trips = testbed.trips_from_events(spark, sf_check)
    approx = quality.fence_stats(trips, testbed.EVENTS, method="approx").first()
    assert approx.fence == pytest.approx(exact.fence, rel=0.01)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "taxi_type", "month", "total_corridas", "avg_total_amount", "avg_passengers"
    ]
    assert df.count() == 10


@pytest.mark.parametrize("name", ["iqr_fence_exact", "gold_hourly_rollup", "bronze_drift_union"])
def test_session_zone_does_not_matter(spark, con, sf_check, conf, name):
    """The tables' timestamps are un-zoned."""
    conf("spark.sql.session.timeZone", "America/New_York")
    df = QUERIES[name](spark, sf_check)
    assert spark_result(df) == duck_result(con, ORACLES[name])


@pytest.mark.parametrize("gone", ["curbside.llm", "corpus_pipeline"])
def test_the_rest_stands_alone(gone):
    """A part that cannot be imported takes its own queries along, no others."""
    code = (
        f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; "
        "print(sorted(e.queries()) == sorted(q.__name__ for q in e._QUERIES), "
        "set(e.oracle_sql()) <= set(e.queries()))"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.split() == ["True", "True"], done.stderr
