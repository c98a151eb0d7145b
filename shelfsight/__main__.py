"""Run queries over a folder of tables: ``python -m shelfsight FOLDER OUT NAME...`` (``--list`` for the names)."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from shelfsight.plans.everything import QUERIES

    if args == ["--list"]:
        print(*sorted(QUERIES), sep="\n")
        return 0
    if len(args) < 3 or (unknown := [n for n in args[2:] if n not in QUERIES]):
        print(__doc__ if len(args) < 3 else f"unknown: {', '.join(unknown)}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("shelfsight").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in args[2:]:
        QUERIES[name](spark, args[0]).write.mode("errorifexists").parquet(f"{args[1]}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
