"""Every registered query against its SQL on the smallest tables, as DuckDB answers it."""

from __future__ import annotations

import math
import os
from decimal import Decimal

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = SF_DIR):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return float(x) if isinstance(x, Decimal) else x if x is None or isinstance(x, (int, str, bool)) else str(x)


def sorted_rows(columns, rows):
    """Rows with their columns by name, in an order that doesn't depend on the engine."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def check(spark, con, query, sql, sf_dir: str = SF_DIR) -> int:
    """Compare a query's rows with its SQL's; returns how many there are."""
    df = query(spark, sf_dir)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    want = sorted_rows(relation.columns, relation.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    differ = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not differ, (got[0], differ[:2])
    return len(got[1])
