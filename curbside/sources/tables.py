"""Stored tables, addressed by path (any URI the session can reach)."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from curbside.spec import DEFAULT_SPEC, TripSpec

# Error conditions that mean "there is no table at this path".
_NO_TABLE = {"PATH_NOT_FOUND", "DELTA_PATH_DOES_NOT_EXIST"}


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """The current snapshot of the table at `path`.

    With a `schema`, a table that has not been written yet is an empty DataFrame
    of that schema; without one it is an error.
    """
    reader = spark.read.format(fmt)
    if schema is not None and fmt != "delta":  # its log has the schema
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if schema is not None and error.getCondition() in _NO_TABLE:
            return spark.createDataFrame([], schema)
        raise


def is_stored(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether there is a table at `path`."""
    try:
        read_table(spark, path, fmt)
    except AnalysisException as error:
        if error.getCondition() in _NO_TABLE:
            return False
        raise
    return True


def from_rows(
    spark: SparkSession,
    rows: Iterable[tuple],
    spec: TripSpec = DEFAULT_SPEC,
    timestamp: T.DataType | None = None,
) -> DataFrame:
    """In-memory trips with the contract's columns and types."""
    return spark.createDataFrame(rows, spec.contract_schema(timestamp))


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, for display. The stored table is never cut."""
    return df.limit(rows)


class TooManyRowsError(ValueError):
    """A result is larger than the caller is ready to take over."""


def hand_over(df: DataFrame, most: int = 100_000) -> pa.Table:
    """The whole result as an Arrow table on the driver, `most` rows at most. A larger one
    is an error, never a part: one row beyond the bound is asked for to tell."""
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise TooManyRowsError(f"more than {most} rows: write the result as a table instead")
    return table
