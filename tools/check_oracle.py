"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver does.

usage: python tools/check_oracle.py [sf_dir] [key-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from graderoom.fixtures import BASE_TABLES  # noqa: E402
from graderoom.registry import ORACLES, QUERIES, load_all  # noqa: E402
from graderoom.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in records), [columns[i] for i in order]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for key, fn in QUERIES.items():
        if wanted and not any(w in key for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: spark error {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if key not in ORACLES:
            print(f"ROWS {key}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(ORACLES[key])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        tmap = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}
        stypes = sorted((c, tmap.get(t, t)) for c, t in df.dtypes)
        otypes = sorted((d[0], str(d[1])) for d in res.description)
        if stypes != otypes:
            print(f"TYPE {key}: spark={stypes} oracle={otypes}")
        sc, sn = rows_of(scols, srows)
        oc, on = rows_of(ocols, orows)
        if sn != on:
            print(f"FAIL {key}: columns spark={sn} oracle={on}")
            bad += 1
        elif sc != oc:
            diff1 = list((sc - oc).items())[:3]
            diff2 = list((oc - sc).items())[:3]
            print(f"FAIL {key}: values differ (spark {len(srows)} rows, oracle {len(orows)})\n  spark-only {diff1}\n  oracle-only {diff2}")
            bad += 1
        else:
            print(f"OK   {key}: {len(srows)} rows ({ts:.1f}s)")
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
