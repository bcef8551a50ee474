"""Batch analytics for trip records on Spark.

`plans` holds the jobs, `operators` the DataFrame -> DataFrame building blocks,
`sources` the readers and writers, `functions` shared column expressions.
"""

from curbside.spec import DEFAULT_SPEC, TripSpec

__all__ = ["DEFAULT_SPEC", "TripSpec"]
