"""Comparison of a Spark result with a DuckDB result, without regard to order."""

import math


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    q = duck.execute(sql)
    names = [x[0] for x in q.description]
    cols = sorted(names)
    return cols, sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
