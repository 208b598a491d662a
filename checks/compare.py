"""Run the registered queries beside their SQL and report differences.

Usage: python -m checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
          "boolean": "BOOLEAN", "date": "DATE"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "\0" if value is None else str(value)


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, sf: str, query, sql: str) -> str | None:
    """None where both sides agree, else what differs."""
    df = query(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
             for f in df.schema.fields}
    given = {d[0]: str(d[1]) for d in result.description}
    if types != given:
        return f"types {sorted(types.items() - given.items())} / {sorted(given.items() - types.items())}"
    ours, other = rows_of(df.columns, mine), rows_of(names, theirs)
    if len(ours) != len(other):
        return f"rows {len(ours)} / {len(other)}"
    for a, b in zip(ours, other):
        if a != b:
            return f"{sum(x != y for x, y in zip(ours, other))} rows differ, first {str(a)[:700]} / {str(b)[:700]}"
    return None


def main(sf: str, only: list[str]) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from fiscolake.session import build_session

    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    con, bad = connect(sf), 0
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = difference(spark, con, sf, query, ORACLES[name])
        except Exception:
            found = traceback.format_exc(limit=3)[-1500:]
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              + (f"\n     {found}" if found else ""), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
