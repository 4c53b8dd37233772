"""Compare DataFrames with each other and with SQL results, regardless of row order."""

import contextlib
import io
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def sort_key(row):
    return tuple((value is not None, value if value is not None else 0) for value in row)


def rows_of(df):
    """All rows as tuples, sorted, columns in the order of the DataFrame."""
    return sorted((tuple(row) for row in df.collect()), key=sort_key)


def plan_of(df, mode="simple"):
    """The text of ``explain``."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


def assert_same(df, connection, sql):
    """Same column names and types, same number of rows, same values."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]) for column in result.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=sort_key)

    assert sorted(df.columns) == sorted(names)
    assert {name: TYPE_NAMES[kind] for name, kind in df.dtypes} == types
    found = rows_of(df.select(*sorted(df.columns)))
    assert len(found) == len(expected)
    for mine, theirs in zip(found, expected):
        for a, b in zip(mine, theirs):
            if isinstance(a, float) and isinstance(b, float):
                assert a == b or math.isclose(a, b, rel_tol=1e-12), (mine, theirs)
            else:
                assert a == b, (mine, theirs)
