"""The jobs a user runs: raw layer, cleaned layer, marts, reports, or all in order."""

from curbside.plans.jobs import (
    BronzeError,
    BronzeRun,
    Lake,
    LakeRun,
    NoMartsError,
    RuleCount,
    SilverRun,
    bronze_all,
    bronze_source,
    bronze_summary,
    gold,
    read_mart,
    read_rollup,
    read_silver,
    report,
    run_all,
    silver,
    write_reports,
)

__all__ = [
    "BronzeError",
    "BronzeRun",
    "Lake",
    "LakeRun",
    "NoMartsError",
    "RuleCount",
    "SilverRun",
    "bronze_all",
    "bronze_source",
    "bronze_summary",
    "gold",
    "read_mart",
    "read_rollup",
    "read_silver",
    "report",
    "run_all",
    "silver",
    "write_reports",
]
