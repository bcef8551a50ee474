"""Column expressions and distributed statistics shared by the operators."""

from curbside.functions.quantiles import approximate_quantiles, discrete_quantiles
from curbside.functions.time import duration_hours, duration_seconds, in_month, month_label

__all__ = [
    "approximate_quantiles",
    "discrete_quantiles",
    "duration_hours",
    "duration_seconds",
    "in_month",
    "month_label",
]
