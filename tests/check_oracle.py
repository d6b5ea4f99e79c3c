"""Compare registered queries with their DuckDB twins: python tests/check_oracle.py SF [NAME PREFIX]..."""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        f = float(x)
        return "nan" if math.isnan(f) else float(f"{f:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def connect(sf):
    import duckdb

    from tessera.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def difference(spark, con, sf, function, sql):
    """None if the rows are equal, else what differs."""
    df = function(spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want), key=repr)
    if got != want:
        odd = [x for x in got if x not in set(want)][:3] if len(got) < 5000 else []
        other = [x for x in want if x not in set(got)][:3] if len(want) < 5000 else []
        return f"{len(got)} and {len(want)} rows; {columns}: {odd} and {other}"
    return None


def main(sf, *prefixes):
    import __spark_entry__ as entry
    from tessera.session import local_session

    spark = local_session(cores=3)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in sorted(queries):
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            said = difference(spark, con, sf, queries[name], oracles[name]) if name in oracles else f"rows {queries[name](spark, sf).count()}"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        if said and not said.startswith("rows ") or time.time() - began > 8 or said:
            bad += bool(said) and not said.startswith("rows ")
            print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
