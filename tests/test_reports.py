"""Report sets over small marts."""

import pytest

from curbside.operators import reports
from curbside.operators.marts import mart_schema
from curbside.operators.quality import ingest_summary
from curbside.sources import preview


@pytest.fixture
def by_type(spark):
    rows = [
        ("yellow", 1, 100, 10.0, 1.0),
        ("yellow", 2, 300, 20.01, 1.0),
        ("green", 2, 7, 5.0, 1.5),
        ("green", 7, 1, 6.0, 2.5),
    ]
    return spark.createDataFrame(rows, mart_schema("trips_by_taxi_type"))


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_labels(by_type):
    assert _rows(reports.type_table(by_type)) == [
        ("green", "Fev", 7, 5.0, 1.5),
        ("green", None, 1, 6.0, 2.5),
        ("yellow", "Jan", 100, 10.0, 1.0),
        ("yellow", "Fev", 300, 20.01, 1.0),
    ]


def test_all_labels(spark):
    df = reports.with_month_label(spark.range(1, 7).selectExpr("cast(id as double) as month"))
    assert dict(df.dtypes)["month"] == "int"
    assert _rows(df) == [(1, "Jan"), (2, "Fev"), (3, "Mar"), (4, "Abr"), (5, "Mai"), (6, None)]


def test_display_tables(spark):
    months = spark.createDataFrame([(2, 2.5, 4), (1, 1.5, 3)], mart_schema("avg_total_by_month"))
    table = reports.month_table(months)
    assert table.columns == ["Mês", "Média (USD)", "Total corridas"]
    assert _rows(table) == [("Jan", 1.5, 3), ("Fev", 2.5, 4)]
    schema = mart_schema("avg_passengers_by_hour")
    hours = spark.createDataFrame([(23, 2.5, 4), (0, 1.5, 3)], schema)
    table = reports.hour_table(hours)
    assert table.columns == ["Hora", "Média passageiros", "Total corridas"]
    assert _rows(table) == [(0, 1.5, 3), (23, 2.5, 4)]


def test_ticket_weighs_months_equally(by_type):
    assert _rows(reports.kpis(by_type)) == [("green", 8, 5.5), ("yellow", 400, 15.01)]


def test_sides_are_aligned_by_month(by_type):
    table = reports.side_by_side(by_type)
    assert table.columns == [
        "month", "mes_nome", "yellow_total_corridas", "yellow_avg_total_amount",
        "green_total_corridas", "green_avg_total_amount",
    ]
    assert _rows(table) == [
        (1, "Jan", 100, 10.0, None, None),
        (2, "Fev", 300, 20.01, 7, 5.0),
        (7, None, None, None, 1, 6.0),
    ]


def test_slice(by_type):
    assert [r.month for r in reports.source_slice(by_type, "green", "month").collect()] == [2, 7]
    assert reports.source_slice(by_type, "blue", "month").count() == 0


def test_facets(spark):
    rows = [("yellow", 9, 5), ("yellow", 3, 4), ("green", 8, 2), ("green", 1, 9)]
    peaks = spark.createDataFrame(rows, mart_schema("top_hours_by_taxi_type"))
    assert _rows(reports.hour_facets(peaks)) == [
        ("green", 1, 9), ("green", 8, 2), ("yellow", 3, 4), ("yellow", 9, 5)
    ]


def test_preview_cuts_the_display_only(spark):
    df = spark.range(48)
    assert preview(df).count() == 20 and preview(df, 3).count() == 3 and df.count() == 48


def test_summary_tells_a_null_source_from_the_total(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "taxi_type string")
    assert _rows(ingest_summary(df)) == [(None, 1), ("a", 2), ("b", 1), ("TOTAL", 4)]
