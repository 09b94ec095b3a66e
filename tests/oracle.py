"""Comparison of a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def _rows(rows):
    return sorted((tuple(map(_norm, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(spark, sf_dir, query, sql):
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    run = con.execute(sql)
    columns = [d[0] for d in run.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert _rows(found.select(*names).collect()) == _rows([r[i] for i in order] for r in run.fetchall())
