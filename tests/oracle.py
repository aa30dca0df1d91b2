"""Holds a query's rows against those of its DuckDB SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that compares alike from either engine."""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if value.__class__.__name__ == "Decimal":
        return plain(float(value)) if value % 1 else int(value)
    return value


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            path = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in cur.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[n]) for n in names) for row in df.collect())


def same(df, sf_dir: str, sql: str) -> None:
    names, got = spark_rows(df)
    expected_names, expected = duck_rows(sf_dir, sql)
    assert names == expected_names, (names, expected_names)
    missing, extra = expected - got, got - expected
    assert not missing and not extra, f"{sum(missing.values())} missing, {sum(extra.values())} extra of {sum(expected.values())}: {list(missing)[:2]} {list(extra)[:2]}"
