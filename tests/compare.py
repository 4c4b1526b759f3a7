"""Compare registered queries with their SQL twins: ``python tests/compare.py [sf_dir] [query ...]``."""

from __future__ import annotations

import collections
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(columns: list[str], data) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(row[i] for i in order) for row in data)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs between the two sides, or None."""
    ours = contract.queries()[name](spark, sf_dir)
    got = rows(ours.columns, ours.collect())
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = rows(columns, result.fetchall())
    kinds = {d[0]: SPARK_TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    if dict(ours.dtypes) != kinds:
        return f"columns {sorted(ours.dtypes)} / {sorted(kinds.items())}"
    if got != expected:
        extra, missing = list((got - expected))[:3], list((expected - got))[:3]
        return f"rows {sum(got.values())} / {sum(expected.values())}; only ours {extra}; only oracle {missing}"
    return None


def main() -> None:
    from joblog.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles = contract.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or contract.queries():
        start = time.time()
        if name not in oracles:
            print(f"{name:28s} no oracle, {contract.queries()[name](spark, sf_dir).count()} rows", flush=True)
            continue
        try:
            fault = difference(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            fault = f"{type(error).__name__}: {str(error)[:600]}"
        bad += fault is not None
        print(f"{name:28s} {'ok' if fault is None else fault} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} differ")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
