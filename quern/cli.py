"""Command line: register files and run one query.

    python -m quern.cli --input sales.csv --table sales --sql "SELECT region, COUNT(*) AS n FROM sales GROUP BY region"
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from quern.errors import PlanningError, QuernError
from quern.session import DEFAULT_BATCH_ROWS, DEFAULT_MEMORY_LIMIT_BYTES, Session, SessionConfig
from quern.sources.files import INFER_ROWS


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="quern", description="Run a SELECT over CSV and Parquet files.")
    found.add_argument("-i", "--input", help="file of the main table")
    found.add_argument("-t", "--table", default="data", help="name of the main table")
    found.add_argument("--register", action="append", default=[], metavar="NAME=PATH", help="a further table; may be repeated")
    found.add_argument("-q", "--sql", required=True)
    found.add_argument("--format", choices=["auto", "csv", "parquet"], default="auto", help="format of the main table")
    found.add_argument("--schema", help="column names and types of the main table where it is CSV, such as 'id BIGINT, name STRING'; inferred otherwise")
    found.add_argument("--infer-rows", type=int, default=INFER_ROWS, help="rows from which CSV types are inferred; 0 for all")
    found.add_argument("--explain", action="store_true", help="print the plans and do not run")
    found.add_argument("--distributed", action="store_true", help="accepted; every plan is distributed")
    found.add_argument("--master", help="cluster to run on; local threads otherwise")
    found.add_argument("--workers", type=int, default=os.cpu_count() or 1)
    found.add_argument("--batch-size", type=int, default=DEFAULT_BATCH_ROWS)
    found.add_argument("--channel-capacity", type=int, default=2, help="accepted; Spark pipelines by itself")
    found.add_argument("--memory-limit-bytes", type=int, default=DEFAULT_MEMORY_LIMIT_BYTES)
    found.add_argument("--show-plan", action="store_true", help="print the plans after the result")
    found.add_argument("--metrics", action="store_true", help="print metrics as JSON to standard error")
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code of one call; ``spark`` is a session to run in, for callers that have one."""
    args = parser().parse_args(argv)
    try:
        config = SessionConfig(args.batch_size, args.channel_capacity, args.workers, args.distributed, args.memory_limit_bytes, args.master)
        session = Session(config, spark)
        if args.input:
            session.register_file(args.table, args.input, args.format, args.schema, args.infer_rows or None)
        for spec in args.register:
            name, equals, path = spec.partition("=")
            if not (name and equals and path):
                raise PlanningError(f"--register takes NAME=PATH, not {spec}")
            session.register_file(name, path, infer_rows=args.infer_rows or None)
        if args.explain:
            print(session.explain(args.sql))
            return 0
        result = session.execute_sql(args.sql)
        print(result.pretty())
        if args.show_plan:
            print(f"\n== Logical plan ==\n{result.logical_plan}\n\n== Optimized plan ==\n{result.optimized_plan}\n== Physical plan ==\n{result.physical_plan}")
        if args.metrics:
            print(result.metrics.to_json(), file=sys.stderr)
        return 0
    except QuernError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
