"""Run registered queries and their SQL on one data folder and compare the rows.

usage: python tools/check_queries.py [folder] [name ...]
"""

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def keyed(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def main() -> int:
    from gridloom.catalog import QUERIES, SQL
    from gridloom.runtime import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names:
        try:
            start = time.time()
            df = QUERIES[name](spark, folder)
            order = sorted(df.columns)
            got = keyed(df.select(*[df[f"`{c}`"] for c in order]).collect())
            took = time.time() - start
            if name not in SQL:
                print(f"{name:32} rows={len(got)} {took:.1f}s (no SQL)", flush=True)
                continue
            start = time.time()
            result = db.execute(SQL[name])
            columns = [d[0] for d in result.description]
            rows = result.fetchall()
            sql_took = time.time() - start
            assert sorted(columns) == order, f"columns {sorted(columns)} != {order}"
            want = keyed([[r[columns.index(c)] for c in order] for r in rows])
            same = got == want
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            note = "" if same else next((f" first difference: {g} | {w}" for g, w in zip(got, want) if g != w), f" rows {len(got)} != {len(want)}")
            bad += not same
            print(f"{'ok  ' if same else 'DIFF'} {name:28} rows={len(got)} spark={took:.1f}s sql={sql_took:.1f}s{note[:300]}", flush=True)
            kinds = dict(zip(columns, [str(d[1]) for d in result.description]))
            if not same:
                print("     ", types, kinds)
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
