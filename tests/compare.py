"""Row-for-row comparison of a registered query with its SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(table: pa.Table) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in an order of their own."""
    names = sorted(table.column_names)
    records = [tuple(r[n] for n in names) for r in table.to_pylist()]
    return names, sorted(records, key=repr)


def expected(con: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    return con.execute(sql).to_arrow_table()
