"""Compare registered queries with their expected results in DuckDB, as the driver does."""

from __future__ import annotations

import decimal
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(_plain(r[i])) for i in order) for r in rows))


def difference(df, con, sql: str, sizes: dict | None = None) -> str | None:
    """None if equal, else a short description of the first difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(cursor.fetchall(), names)
    actual = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sizes is not None:
        sizes["rows"] = len(actual)
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {sorted(names)}"
    if len(expected) != len(actual):
        return f"rows: spark {len(actual)} sql {len(expected)}"
    for a, b in zip(actual, expected):
        if a != b:
            return f"first difference:\n  spark {a}\n  sql   {b}"
    return None


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries), set(sqls) - set(queries)
    print("no SQL:", sorted(set(queries) - set(sqls)))
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            sizes = {}
            problem = difference(df, con, sqls[name], sizes) if name in sqls else None
            count = df.count() if problem is None and name not in sqls else ""
        except Exception:
            problem = traceback.format_exc(limit=3)[-1500:]
        status = "ok" if problem is None else "BAD"
        bad += problem is not None
        print(f"{status:4} {name} {time.time() - start:.2f}s {sizes} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
