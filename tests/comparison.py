"""Comparison of two engines' rows, whatever their order."""


def value(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    return repr(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(value(r[c]) for c in names) for r in df.collect())


def duck_rows(con, sql):
    found = con.sql(sql)
    columns, rows = list(found.columns), found.fetchall()
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted(tuple(value(r[i]) for i in at) for r in rows)
