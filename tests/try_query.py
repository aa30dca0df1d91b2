"""python tests/try_query.py NAME... [--sf DIR]: runs queries and holds each against its SQL."""

from __future__ import annotations

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

if __name__ == "__main__":
    import __spark_entry__
    from oracle import same, spark_rows

    from vantage.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        k = args.index("--sf")
        sf = args[k + 1]
        del args[k : k + 2]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                same(df, sf, oracles[name])
                print("ok  ", name, round(time.time() - began, 1), df.columns, flush=True)
            else:
                names, rows = spark_rows(df)
                print("rows", name, round(time.time() - began, 1), names, sum(rows.values()), list(rows)[:2], flush=True)
        except Exception as e:
            print("BAD ", name, type(e).__name__, str(e)[:1500], flush=True)
