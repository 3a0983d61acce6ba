"""Results as sorted rows of plain values."""

import datetime
import math
from decimal import Decimal


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, (float, Decimal)) or isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.9g}" if abs(x) < 1e15 else str(int(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ", "microseconds")
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, duck, sql):
    """The rows of both, after their names are found equal."""
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    return rows(df.columns, df.collect()), rows(names, answer.fetchall())
