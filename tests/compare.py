"""Rows of a Spark result and of SQL, made comparable."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def sql_rows(duck, sql):
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
