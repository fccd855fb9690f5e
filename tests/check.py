"""Compare registered queries with their DuckDB statements: python tests/check.py SF_DIR [names]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def open_oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def bag(columns: list[str], rows) -> list[tuple]:
    """Rows with their columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_bag(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), bag(df.columns, df.collect())


def oracle_bag(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(columns), bag(columns, result.fetchall())


TYPES = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def type_gaps(df, con, sql: str) -> list[str]:
    ours = {f.name: TYPES.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema.fields}
    theirs = {c[0]: str(c[1]) for c in con.execute(sql).description}
    return [f"{n}: {ours[n]} / {theirs.get(n)}" for n in ours if ours[n] != theirs.get(n)]


def main() -> int:
    from helixframe.session import build_session
    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = open_oracle(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            df = build(spark, sf_dir)
            columns, rows = spark_bag(df)
            took = time.time() - begin
            if name not in oracles:
                print(f"rows-only {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            want_columns, want = oracle_bag(con, oracles[name])
            gaps = type_gaps(df, con, oracles[name])
            ok = columns == want_columns and rows == want and not gaps
            bad += not ok
            print(f"{'ok' if ok else 'BAD'} {name} {len(rows)}/{len(want)} {took:.1f}s {gaps or ''}", flush=True)
            if not ok:
                if columns != want_columns:
                    print("   columns", columns, want_columns)
                print("   only ours", list(set(rows) - set(want))[:2])
                print("   only oracle", list(set(want) - set(rows))[:2])
        except Exception as error:
            bad += 1
            print(f"FAILED {name}: {str(error)[:600]}", flush=True)
            if only:
                traceback.print_exc()
    missing = set(oracles) - set(entry.queries())
    print("bad:", bad, "statements without a query:", missing)
    return 1 if bad or missing else 0


if __name__ == "__main__":
    sys.exit(main())
