"""``python -m tapestride QUERY --data FOLDER --out FOLDER``: runs a query of the catalogue and writes its rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalogue
from .sources import tables


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tapestride")
    parser.add_argument("query", choices=sorted(catalogue.QUERIES))
    parser.add_argument("--data", required=True, help="folder with a Parquet table per name")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=["parquet", "tsv"], default="parquet")
    given = parser.parse_args(arguments)
    rows = catalogue.QUERIES[given.query](SparkSession.builder.appName(f"tapestride {given.query}").getOrCreate(), given.data)
    tables.write_tsv(rows, given.out) if given.format == "tsv" else rows.write.mode("overwrite").parquet(given.out)


if __name__ == "__main__":
    main()
