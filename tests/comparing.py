"""Order-insensitive comparison of a Spark and a DuckDB result."""

import math


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float) and x.is_integer():
        return int(x)
    return x


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(df, relation):
    found = rows_of(df.columns, df.collect())
    wanted = rows_of(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert len(found) == len(wanted)
    assert found == wanted
