"""Run every registered query in Spark and its oracle in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and order-insensitive values (doubles
rounded to 6 digits).  Prints one line per query and a summary.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from credence.session import local_session  # noqa: E402
from credence.sources.tables import TABLES  # noqa: E402


TYPE_MAP = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
            "BOOLEAN": "boolean", "STRING": "string", "NUMBER": "double"}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows  ({ts:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(dcols)}")
            bad += 1
            continue
        stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        dtypes = {c: TYPE_MAP.get(str(t), str(t)) for c, t in
                  zip(dcols, [d[1] for d in res.description])}
        if stypes != dtypes:
            diff = {c: (stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)}
            print(f"TYPE {name}: {diff}")
        a, b = rows_of(cols, srows), rows_of(dcols, drows)
        if a != b:
            diff = [x for x in a if x not in set(b)][:3] if len(a) < 200000 else a[:1]
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}; e.g. spark {diff} ")
            bad += 1
            continue
        print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
    print(f"{bad} failures")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
