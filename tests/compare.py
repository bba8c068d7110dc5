"""Rows of a Spark result and of DuckDB as comparable sorted lists."""

import datetime
import decimal
import math


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_value(r[n]) for n in names) for r in df.collect())


def duck_rows(rel):
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(tuple(_value(r[i]) for i in at) for r in rel.fetchall())
