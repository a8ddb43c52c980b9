"""Command line: ``python -m corpusloom list`` and ``python -m corpusloom run QUERY TABLES OUT [--format csv]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corpusloom.plans import catalog
from corpusloom.sources.readers import write_csv


def arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="corpusloom", description="Queries over a folder of tables.")
    actions = parser.add_subparsers(dest="action", required=True)
    actions.add_parser("list", help="names of all queries")
    run = actions.add_parser("run", help="one query, written as a folder of files")
    run.add_argument("query")
    run.add_argument("tables", help="folder with one parquet table each")
    run.add_argument("out", help="folder that is written; it may not exist yet")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    run.add_argument("--overwrite", action="store_true", help="replace the folder if it exists")
    return parser.parse_args(given)


def main(given: list[str], spark: SparkSession | None = None) -> int:
    """Runs a command; 2 for a query that is not known."""
    asked, queries = arguments(given), catalog.queries()
    if asked.action == "list":
        print("\n".join(sorted(queries)))
        return 0
    if asked.query not in queries:
        print(f"no query is named {asked.query}", file=sys.stderr)
        return 2
    session = spark or SparkSession.builder.appName(f"corpusloom {asked.query}").getOrCreate()
    mode, rows = "overwrite" if asked.overwrite else "errorifexists", queries[asked.query](session, asked.tables)
    write_csv(rows, asked.out, mode) if asked.format == "csv" else rows.write.mode(mode).format(asked.format).save(asked.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
