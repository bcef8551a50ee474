"""Command line: ``python -m curbside <job> --root URI --landing URI``.

Suited to `spark-submit` as well; the session's settings come from there.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from curbside.plans import jobs
from curbside.spec import DEFAULT_SPEC


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="curbside")
    parser.add_argument("job", choices=["bronze", "silver", "gold", "report", "all"])
    parser.add_argument("--root", required=True, help="folder that holds the layers")
    parser.add_argument("--landing", default="", help="folder of the landed monthly files")
    parser.add_argument("--format", default="parquet", help="table format of all layers")
    parser.add_argument("--months", nargs="+", help="landed months to read, as yyyy-mm")
    parser.add_argument("--period-start", help="first pickup instant that is kept")
    parser.add_argument("--period-end", help="last pickup instant that is kept")
    parser.add_argument("--layout", default="arrival", choices=jobs.LAYOUTS,
                        help="how rows of the cleaned table get to its files")
    parser.add_argument("--changed", nargs="+", type=int, metavar="yyyymm",
                        help="replace only these months (silver needs --fence)")
    parser.add_argument("--fence", type=float, help="hours; computed, if not given")
    parser.add_argument("--out", help="folder on this machine for the report sets, as CSV")
    parser.add_argument("--most", type=int, default=100_000, help="rows a report set may have")
    args = parser.parse_args(argv)
    if args.job in ("bronze", "all") and not args.landing:
        parser.error(f"{args.job} needs --landing")

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(f"curbside-{args.job}").getOrCreate()
    changes = {
        "landing_months": args.months and tuple(args.months),
        "period_start": args.period_start,
        "period_end": args.period_end,
    }
    spec = replace(DEFAULT_SPEC, **{name: value for name, value in changes.items() if value})
    lake = jobs.Lake(root=args.root, landing=args.landing, fmt=args.format, spec=spec)
    if args.job in ("bronze", "all"):
        jobs.bronze_all(spark, lake)
        jobs.bronze_summary(spark, lake).show(truncate=False)
    if args.job in ("silver", "all"):
        run = jobs.silver(
            spark, lake, layout=args.layout, months=args.changed, fence=args.fence
        )
        run.by_source.show()
        run.by_month.show()
    if args.job in ("gold", "all"):
        jobs.gold(spark, lake, show=True, months=args.changed)
    if args.job == "report":
        sets = jobs.report(spark, lake)
        for name, table in sets.items():
            print(name)
            table.show(truncate=False)
        if args.out:
            jobs.write_reports(sets, args.out, args.most)


if __name__ == "__main__":
    main()
