"""Rows of a DataFrame against rows of an oracle, in any order."""

import datetime
import decimal
import math


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r.asDict(True)[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
