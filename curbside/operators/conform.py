"""Bringing differing inputs to one shape: renames, selection, unions by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.spec import DEFAULT_SPEC, TripSpec

_INSTANTS = (T.TimestampType, T.TimestampNTZType)


# Types that widen to a contract type without losing a value (a whole number beyond 2^53
# is no passenger count and no amount).
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_WIDENS = {
    T.LongType: _WHOLE,
    T.DoubleType: (*_WHOLE, T.FloatType),
    T.TimestampType: _INSTANTS,
}


class ContractTypeError(TypeError):
    """A contract column has a type that does not widen to the contract's."""


class MixedTimestampsError(TypeError):
    """One column is a zoned timestamp in one input and an un-zoned one in another."""


def tag_source(df: DataFrame, source: str, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """Mark every row with the source it came from."""
    return df.withColumn(spec.source, F.lit(source))


def conform(df: DataFrame, source: str, spec: TripSpec = DEFAULT_SPEC) -> DataFrame:
    """A source's raw table under the common names, cut to the contract columns.

    Names to be replaced may be absent; a missing contract column is an error. Narrower
    whole numbers and floats widen to the contract's types; timestamps keep their
    flavour; a column of any other type raises `ContractTypeError`, before a job runs.
    """
    named = df.withColumnsRenamed(dict(spec.renames.get(source, {}))).select(*spec.contract)
    wanted = spec.contract_schema()
    wrong = [
        f"{has.name} is {has.dataType.simpleString()}, not {want.dataType.simpleString()}"
        for has, want in zip(named.schema, wanted)
        if has.dataType != want.dataType
        and not isinstance(has.dataType, _WIDENS.get(type(want.dataType), ()))
    ]
    if wrong:
        raise ContractTypeError(f"{source}: {'; '.join(wrong)}")
    return named.withColumns({
        has.name: F.col(has.name).cast(want.dataType)
        for has, want in zip(named.schema, wanted)
        if has.dataType != want.dataType and not isinstance(has.dataType, _INSTANTS)
    })


def drift_union(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name of inputs that drifted apart: absent columns are filled with
    null, numeric types widen, names match regardless of case."""
    _same_time_flavour(dfs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def strict_union(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name of inputs with the same columns. Duplicates are kept."""
    _same_time_flavour(dfs)
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _same_time_flavour(dfs: Sequence[DataFrame]) -> None:
    # Spark would widen un-zoned to zoned without a word, moving wall-clock times
    # into the session's zone.
    seen: dict[str, type] = {}
    for df in dfs:
        for column in df.schema:
            if isinstance(column.dataType, _INSTANTS):
                flavour = type(column.dataType)
                if seen.setdefault(column.name.lower(), flavour) is not flavour:
                    raise MixedTimestampsError(
                        f"{column.name} is both a zoned and an un-zoned timestamp"
                    )
