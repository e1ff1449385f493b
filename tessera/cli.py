"""python -m tessera.cli (--sql TEXT | --file FILE | --query NAME) --data DIR [--format parquet|tbl] [--explain] [--rows N]"""

from __future__ import annotations

import argparse
import time

from .catalog import register_files, register_views
from .operators import QUERIES as OPERATORS
from .plans.tpch import QUERIES_SQL
from .session import session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Run SQL over star-schema tables.")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--sql", help="SQL text")
    what.add_argument("--file", help="a file with SQL text")
    what.add_argument("--query", choices=sorted(QUERIES_SQL.keys() | OPERATORS.keys()), help="a query of the library")
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--format", choices=["parquet", "tbl"], default="parquet")
    parser.add_argument("--explain", action="store_true", help="print the physical plan instead of rows")
    parser.add_argument("--rows", type=int, default=10, help="rows to print")
    parser.add_argument("--master", default=None)
    a = parser.parse_args(arguments)
    spark = session(a.master)
    (register_views if a.format == "parquet" else register_files)(spark, a.data)
    began = time.perf_counter()
    if a.query in OPERATORS:
        df = OPERATORS[a.query](spark, a.data)
    else:
        text = a.sql or QUERIES_SQL.get(a.query or "")
        if text is None:
            with open(a.file, encoding="utf-8") as f:
                text = f.read().strip().rstrip(";")
        df = spark.sql(text)
    planned = time.perf_counter()
    if a.explain:
        df.explain("formatted")
    else:
        df.show(a.rows, truncate=False)
    print(f"planning {planned - began:.3f} s, execution {time.perf_counter() - planned:.3f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
