"""Runs registered queries and compares them with their SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = os.environ.get("TILLROLL_TESTDATA", "/root/testdata")


def session(
    cpus: str = "8", partitions: str = "8", folder: str | None = None
) -> SparkSession:
    builder = SparkSession.builder
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("tillroll")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "TINYINT": "tinyint", "SMALLINT": "smallint",
    "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "HUGEINT": "hugeint",
}


def _key(v):
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (0, round(v, 7))
    return (2, "") if v is None else (0, v)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result, none if they agree."""
    names = sorted(df.columns)
    got = sorted(
        (tuple(_key(r[n]) for n in names) for r in df.select(*names).collect()), key=repr
    )
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(cols) != names:
        return [f"columns {names} != {sorted(cols)}"]
    want = sorted(
        (tuple(_key(r[cols.index(n)]) for n in names) for r in rel.fetchall()), key=repr
    )
    out = []
    spark_types = dict(df.dtypes)
    for n in names:
        if TYPES.get(types[n], types[n]) != spark_types[n]:
            out.append(f"type of {n}: spark {spark_types[n]}, sql {types[n]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        show = [
            {n: (x[1], y[1]) for n, x, y in zip(names, a, b) if x != y} for a, b in bad[:2]
        ]
        out.append(f"{len(bad)} rows differ, e.g. {show}")
    return out


def main() -> None:
    import __spark_entry__ as entry

    wanted = sys.argv[2:]
    sf_dir = f"{DATA}/{sys.argv[1]}"
    spark = session()
    con = database(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problems = compare(df, con, oracle[name])
                rows = ""
            else:
                rows = f"{df.count()} rows, no sql"
                problems = []
        except Exception as e:  # report and go on with the next query
            problems, rows = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {rows}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failed", failed)
    spark.stop()


if __name__ == "__main__":
    main()
