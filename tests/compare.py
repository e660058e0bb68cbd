"""Comparison of a Spark result with DuckDB's, regardless of order and of how numbers are typed."""

import datetime
import decimal


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return int(value) if float(value).is_integer() else round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in rows))


def same(frame, relation):
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = rows_of([d[0] for d in relation.description], relation.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
