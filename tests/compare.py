"""Compares a query's rows with its SQL, independent of row and column order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return round(float(x), 5)
    return str(x)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def assert_same(df, con, sql):
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    want = rows_of(result.fetchall(), [c[0] for c in result.description])
    assert got == want
