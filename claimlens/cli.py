"""Command line: run a catalog query over a folder of tables and write or show its rows.

    claimlens list
    claimlens run QUERY FOLDER [--out FOLDER]
    claimlens sql QUERY
"""

from __future__ import annotations

import argparse
import sys


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    one = commands.add_parser("sql", help="the SQL that gives a query's rows")
    one.add_argument("query")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("query")
    run.add_argument("folder", help="folder of the input tables")
    run.add_argument("--out", help="folder for Parquet; without it, the first rows are shown")
    options = parser.parse_args(arguments)

    from .catalog import ORACLE_SQL, QUERIES

    if options.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if options.query not in QUERIES:
        print(f"no query {options.query!r}", file=sys.stderr)
        return 2
    if options.command == "sql":
        print(ORACLE_SQL.get(options.query, "-- SQL can't express this query"))
        return 0
    from pyspark.sql import SparkSession

    rows = QUERIES[options.query](SparkSession.builder.getOrCreate(), options.folder)
    if options.out:
        rows.write.mode("errorifexists").parquet(options.out)
    else:
        rows.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
