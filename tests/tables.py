"""The given tables, and how results of Spark and DuckDB are compared."""

import decimal
import math
import os

SF_DIR = os.path.join("/root/testdata", os.environ.get("TEST_SF", "sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value in a form that both engines share; floats to nine significant digits."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.9g}") + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, duck, query, sql, sf_dir=SF_DIR):
    """Rows of the Spark query and of the SQL, with columns by name; asserts that they are the same."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    other = rows_of(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(mine) == len(other)
    assert [p for p in zip(mine, other, strict=True) if p[0] != p[1]][:3] == []
    return len(mine)
