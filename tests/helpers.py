"""Comparison of a query with its SQL."""

import os


def oracle(folder):
    """A DuckDB connection with the tables of a folder."""
    import duckdb

    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}"
            connection.execute(f"create view {name[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return connection


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(r[i] for i in places)) for r in relation.fetchall())
    assert ours == theirs
