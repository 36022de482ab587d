"""Compares a query with its SQL on the small tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return "NULL"
    return str(v) if isinstance(v, (bool, str, bytes)) else str(round(float(v), 6) + 0.0)


def same(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    rows = sorted(tuple(cell(r[columns.index(n)]) for n in names) for r in want.fetchall())
    assert sorted(tuple(cell(r[n]) for n in names) for r in got.collect()) == rows
