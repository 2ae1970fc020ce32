"""python -m quorumlake QUERY FOLDER OUT: runs a query over a folder of tables and writes Parquet."""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark.sql import SparkSession

PLANS = ["quorumlake.plans.dated", "quorumlake.plans.records", "quorumlake.plans.debates", "quorumlake.plans.streams", "quorumlake.plans.more", "quorumlake.plans.functions", "quorumlake.plans.lists", "quorumlake.plans.changes", "quorumlake.plans.readers", "quorumlake.plans.shown"]


def jobs() -> dict:
    """All queries of the core; those of add-on packages are run through the driver's entry file."""
    return {k: f for m in PLANS for k, f in import_module(m).QUERIES.items()}


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in jobs():
        print(__doc__, *sorted(jobs()), sep="\n")
        return 2
    jobs()[args[0]](SparkSession.builder.getOrCreate(), args[1]).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
