"""Compare registered queries with their SQL on one data folder: python tests/check.py [names or prefixes]"""
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(df):
    df = df.reindex(sorted(df.columns), axis=1)
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if v is None or (isinstance(v, float) and v != v) else
                          (float(v) + 0.0 if isinstance(v, float) else v) for v in r))
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df, sql, con):
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns
             if got[c].dtype != want[c].dtype and len(got)}
    a, b = norm(got), norm(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]} types {kinds}", len(got)
    return (f"types {kinds}" if kinds else None), len(got)


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def main():
    path = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from loomgraph.core.session import local_session
    from loomgraph.plans import catalog
    mods = os.environ.get("MODS")
    if mods:
        import importlib
        for m in mods.split(","):
            importlib.import_module(f"loomgraph.plans.{m}")
        names = {n: (lambda s, p, fn=fn: fn(catalog.Tables(s, p))) for n, (fn, _) in catalog.CATALOG.items()}
        sqls = {n: s for n, (_, s) in catalog.CATALOG.items() if s}
    else:
        names, sqls = catalog.queries(), catalog.oracle_sql()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    want = sys.argv[1:]
    bad = 0
    for name, fn in names.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t0 = time.time()
        try:
            df = fn(spark, path)
            if name in sqls:
                note, n = compare(df, sqls[name], con)
            else:
                n = len(df.toPandas())
                note = None if n else "no rows"
        except Exception as e:
            note, n = "ERROR " + (str(e)[:600] if os.environ.get("BRIEF", "1") == "1" else traceback.format_exc()), -1
        bad += note is not None
        print(f"{'ok ' if note is None else 'BAD'} {time.time()-t0:6.2f}s {n:7d} {name}{'' if name in sqls else ' (rows only)'} {note or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
