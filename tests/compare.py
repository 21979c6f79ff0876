"""Run registered queries against their SQL twins: ``python -m tests.compare SF_DIR [names]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(df, con: duckdb.DuckDBPyConnection, statement: str) -> str | None:
    """``None`` if both sides give the same columns and the same multiset of rows."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = _rows(df.columns, df.collect())
    if actual == expected:
        return None
    extra, missing = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
        f"extra {list(extra)[:3]}; missing {list(missing)[:3]}"
    )


def main() -> None:
    import __spark_entry__ as contract
    from tests.conftest import make_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            diff = difference(queries[name](spark, sf_dir), con, oracle[name])
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        failed += diff is not None
        outcome = "ok" if diff is None else diff
        print(f"{name:28} {time.time() - start:6.1f}s  {outcome}"[:900], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
